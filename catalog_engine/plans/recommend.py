"""Recommendations: nearest items with their attributes (P5)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalog_engine import rules, runtime
from catalog_engine.functions import text
from catalog_engine.operators import similar
from catalog_engine.operators.keys import listed
from catalog_engine.operators.search import search

# Up to so many keys go into the scan of the items as literals.
LITERAL_KEYS = 100


def _keyed_like(items: DataFrame, embeddings: DataFrame, key: str) -> DataFrame:
    """``items`` with keys of the embeddings' type: text keys become numbers, others than numbers are left out."""
    numbers = isinstance(embeddings.schema[key].dataType, T.IntegralType)
    if not (numbers and isinstance(items.schema[key].dataType, T.StringType)):
        return items
    return items.withColumn(key, text.to_key(key)).filter(F.col(key).isNotNull())


def recommend(
    items: DataFrame,
    embeddings: DataFrame,
    target,
    n: int = rules.RECOMMENDATIONS,
    key: str = "id",
    vec: str = "embedding",
    columns: Sequence[str] | None = None,
    how: str = "inner",
) -> DataFrame:
    """The ``n`` items nearest to one target, nearest first, with attributes.

    ``how="left"`` keeps neighbours that have no attribute row.  The neighbours
    are written down before their attributes are joined.  Keys that are text
    among the items and numbers among the embeddings meet as numbers.
    """
    if isinstance(target, str) and isinstance(embeddings.schema[key].dataType, T.IntegralType):
        if not target.strip().lstrip("+-").isdecimal():
            raise ValueError(f"{key} {target!r} has no vector")
        target = int(target)
    top = runtime.checkpointed(similar.top_n_similar(embeddings, key, vec, target, n))
    items = _keyed_like(items, embeddings, key)
    wanted = items.select(key, *(columns or [c for c in items.columns if c != key]))
    if n <= LITERAL_KEYS:
        # With literal keys the scan of the items can skip files and row groups that hold none of them.
        wanted = wanted.filter(F.col(key).isin([r[key] for r in top.collect()]))
    return similar.attach(top, wanted, key, how).orderBy(F.desc_nulls_last("similarity"), key)


def find_and_recommend(
    items: DataFrame,
    embeddings: DataFrame,
    term: str,
    n: int = rules.RECOMMENDATIONS,
    name: str = "name",
    key: str = "id",
    vec: str = "embedding",
    columns: Sequence[str] | None = None,
    tie_cols: Sequence[str] = ("release_year",),
) -> DataFrame:
    """Search by name, take the best hit, recommend from it (T5)."""
    best = search(items, term, name, key, limit=1, tie_cols=tie_cols).select(key).first()
    if best is None:
        raise ValueError(f"nothing matches {term!r}")
    return recommend(items, embeddings, best[0], n, key, vec, columns)


def recommend_batch(
    items: DataFrame,
    embeddings: DataFrame,
    targets: DataFrame,
    n: int = rules.RECOMMENDATIONS,
    key: str = "id",
    vec: str = "embedding",
    columns: Sequence[str] | None = None,
    how: str = "inner",
) -> DataFrame:
    """The same for every row of ``targets`` (a table of keys).

    The neighbours are written down before their attributes are joined: a list
    that turns out small then meets the items without shuffling them.
    """
    items, targets = _keyed_like(items, embeddings, key), _keyed_like(targets, embeddings, key)
    vectors = listed(embeddings, runtime.written(targets.select(key)), key)
    top = runtime.written(similar.top_n_batch(embeddings, vectors, key, vec, n))
    wanted = items.select(key, *(columns or [c for c in items.columns if c != key]))
    return similar.attach(top, wanted, key, how)
