"""Embedding jobs: only new rows, or new and changed ones."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalog_engine import runtime
from catalog_engine.functions import text
from catalog_engine.operators import changes
from catalog_engine.operators.dedupe import dedupe_best
from catalog_engine.operators.encode import Model, encode
from catalog_engine.operators.keys import listed
from catalog_engine.operators.upsert import upsert


def with_long_key(items: DataFrame, key: str, text_col: str) -> DataFrame:
    """(key, text) with the key as long; rows whose key is not numeric are left out."""
    return items.select(text.to_key(key).alias(key), text_col)


def rejected_keys(items: DataFrame, key: str) -> DataFrame:
    """Rows the embedding jobs leave out because their key is not numeric."""
    return items.filter(text.to_key(key).isNull())


def best_text(text_col: str, prefer: str | None = None) -> list[Column]:
    """Which of several rows with one key is embedded: the largest ``prefer``, then the largest text."""
    return [F.desc(c) for c in (prefer, text_col) if c is not None]


def rows_to_embed(
    items: DataFrame,
    stored: DataFrame,
    mode: str,
    key: str = "id",
    text_col: str = "perfume_string",
    prefer: str | None = None,
) -> DataFrame:
    """(key, text) of the rows a run has to encode.

    ``mode="new"``: the key is not stored.  ``mode="changed"``: also keys
    whose stored text differs.  Decided before the encoder runs.  Of several
    items with one number as key the one that :func:`best_text` puts first counts.

    What to encode is found once, from keys and digests alone, and written down;
    the list then fetches its texts, a short one without shuffling the item table.
    """
    if mode not in ("new", "changed"):
        raise ValueError(f"mode must be 'new' or 'changed', not {mode!r}")
    extra = [prefer] if prefer else []
    ready = changes.rows_with_text(items.select(text.to_key(key).alias(key), text_col, *extra), key, text_col)
    if mode == "new":
        on, found = [key], changes.new_rows(ready, stored, key)
    else:
        on = [key, changes.DIGEST]
        ready = changes.with_digest(ready, text_col)
        found = changes.stale_rows(ready, stored, key, text_col)
    wanted = runtime.written(found.select(*on))
    # The best of all rows of a key, also where another row of it is the stored one.
    best = dedupe_best(listed(ready, wanted, key), [key], best_text(text_col, prefer))
    if mode == "changed":
        best = listed(best, wanted, *on)
    return best.select(key, text_col)


def embed(
    items: DataFrame,
    stored: DataFrame,
    encoder: Callable[[], Model],
    mode: str = "changed",
    key: str = "id",
    text_col: str = "perfume_string",
    vec: str = "embedding",
    prefer: str | None = None,
) -> DataFrame:
    """New state of the embedding table.

    ``mode="new"`` only adds rows; a job that appends to a stored table writes
    just :func:`new_embeddings` instead.
    """
    fresh = new_embeddings(items, stored, encoder, mode, key, text_col, vec, prefer)
    if mode == "new":
        return stored.unionByName(fresh, allowMissingColumns=True)
    return upsert(
        stored, fresh, key, update_cols=[text_col, vec], insert_cols=[key, text_col, vec], null_keys=False
    )


def new_embeddings(
    items: DataFrame,
    stored: DataFrame,
    encoder: Callable[[], Model],
    mode: str = "new",
    key: str = "id",
    text_col: str = "perfume_string",
    vec: str = "embedding",
    prefer: str | None = None,
) -> DataFrame:
    """The (key, text, vector) rows a run adds or replaces."""
    return encode(rows_to_embed(items, stored, mode, key, text_col, prefer), text_col, encoder, vec)


def embedded_count(stored: DataFrame, vec: str = "embedding") -> DataFrame:
    """How many rows have a vector (A3)."""
    return stored.filter(F.col(vec).isNotNull()).agg(F.count(F.lit(1)).alias("embedded"))
