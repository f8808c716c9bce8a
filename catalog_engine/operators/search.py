"""Fuzzy name search, for one term or a table of terms."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from catalog_engine import rules, runtime
from catalog_engine.functions import fuzzy, grams, text
from catalog_engine.operators import pairing


OUTER_SPACE = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"


def search(
    items: DataFrame,
    term: str,
    name: str = "name",
    key: str = "id",
    threshold: float = rules.SEARCH_THRESHOLD,
    limit: int = rules.SEARCH_LIMIT,
    tie_cols: Sequence[str] = ("release_year",),
    aliases: Sequence[tuple[str, str]] = rules.PHRASE_ALIASES,
) -> DataFrame:
    """The best ``limit`` rows scoring above ``threshold``, with their ``score``.

    Ordered by score, then ``tie_cols`` descending, then key.  A blank term
    finds nothing.
    """
    if not term.strip():
        return items.withColumn("score", F.lit(0.0)).filter(F.lit(False))
    norm = text.normalize_aliases(name, aliases)
    score = fuzzy.normalized_score(F.col("_norm"), text.normalize_term(term, aliases), threshold)
    return (
        items.withColumn("_norm", norm)
        .withColumn("score", score)
        .drop("_norm")
        .filter(F.col("score") > threshold)
        .orderBy(F.desc("score"), *[F.desc_nulls_last(c) for c in tie_cols], key)
        .limit(limit)
    )


def search_terms(
    items: DataFrame,
    terms: DataFrame,
    term: str = "term",
    name: str = "name",
    key: str = "id",
    threshold: float = rules.SEARCH_THRESHOLD,
    limit: int = rules.SEARCH_LIMIT,
    tie_cols: Sequence[str] = (),
    columns: Sequence[str] = (),
    aliases: Sequence[tuple[str, str]] = rules.PHRASE_ALIASES,
    max_bytes: int = runtime.BROADCAST_BYTES,
) -> DataFrame:
    """:func:`search` for every distinct term, as (term, key, ..., score, rank).

    Carries the key, ``tie_cols`` and ``columns`` of each hit.  Every task
    scores each distinct name of a block once and keeps a running top list per
    term, so names are not shuffled.
    """
    carried = list(dict.fromkeys([key, *tie_cols, *columns]))
    names = items.select(*carried, text.normalize_aliases(name, aliases).alias("_norm"))
    # White space of every kind, as a single term loses it.
    trimmed = F.regexp_replace("term", OUTER_SPACE, "")
    wanted = (
        terms.select(F.col(term).alias("term"))
        .filter(trimmed != "")
        .distinct()
        .select("term", text.normalize_aliases(trimmed, aliases).alias("_norm"))
    )
    kinds = dict(items.dtypes)
    scored = pairing.score_blocks(
        names,
        wanted,
        lambda block: _TermHits(block, carried, key, list(tie_cols), threshold, limit),
        "term string, " + ", ".join(f"`{c}` {kinds[c]}" for c in carried) + ", score double",
        F.octet_length("_norm") * 8 + 64,
        max_bytes,
    )
    order = [F.desc("score"), *[F.desc_nulls_last(c) for c in tie_cols], F.col(key)]
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("term").orderBy(*order)))
    return ranked.filter(F.col("rank") <= limit)


# Hits of a block that are gathered before the lists are cut.
HELD = 1 << 18


def _rows_of(codes: np.ndarray, n: int) -> list[np.ndarray]:
    """The rows of each of ``n`` codes."""
    order = np.argsort(codes, kind="stable")
    ends = np.searchsorted(codes[order], np.arange(n + 1))
    return [order[start:end] for start, end in zip(ends[:-1], ends[1:])]


class _TermHits:
    """Running top list per term over blocks of names."""

    def __init__(self, terms: pa.Table, carried: list[str], key: str, ties: list[str], threshold: float, limit: int):
        self.terms = terms.column("term").to_pylist()
        # Terms that are the same when normalised are looked for once.
        coded = terms.column("_norm").combine_chunks().dictionary_encode()
        self.index = grams.TermIndex(coded.dictionary.to_pylist())
        self.asked = _rows_of(coded.indices.to_numpy(zero_copy_only=False), len(coded.dictionary))
        self.carried, self.threshold, self.limit = carried, threshold, limit
        self.order = ["score", *ties, key]
        self.rising = [False] * (1 + len(ties)) + [True]
        #: Best hits so far: a row each, with the number of its term in ``_term``.
        self.best: pa.Table | None = None
        self.schema: pa.Schema | None = None

    def add(self, block: pa.Table) -> None:
        rows = block.select(self.carried)
        self.schema = rows.schema
        coded = block.column("_norm").combine_chunks().dictionary_encode()
        names = fuzzy.NameBlock(coded.dictionary.to_pylist())
        at = coded.indices.to_numpy(zero_copy_only=False)
        rows_of = _rows_of(np.where(np.isnan(at.astype(float)), -1, at).astype(int), len(coded.dictionary))
        found, held = [], 0
        for scored in self.index.scores(names, self.threshold):
            for n, t, score in zip(*scored):
                hit, terms = rows_of[n], self.asked[t]
                found.append((np.repeat(terms, len(hit)), np.tile(hit, len(terms)), np.full(len(hit) * len(terms), score)))
                held += len(hit) * len(terms)
                if held >= HELD:
                    self._keep(rows, found)
                    found, held = [], 0
        if found:
            self._keep(rows, found)

    def _keep(self, rows: pa.Table, found: list) -> None:
        """Add hits of a block and cut every term's list to the limit."""
        term, hit, score = (np.concatenate(c) for c in zip(*found))
        both = rows.take(pa.array(hit)).append_column("score", pa.array(score)).append_column("_term", pa.array(term))
        if self.best is not None:
            both = pa.concat_tables([self.best, both])
        ranks = pd.DataFrame({c: both.column(c).to_pandas() for c in ["_term", *self.order]})
        ranks = ranks.sort_values(["_term", *self.order], ascending=[True, *self.rising], na_position="last")
        self.best = both.take(pa.array(ranks.groupby("_term").head(self.limit).index.to_numpy()))

    def result(self) -> pa.Table:
        if self.best is not None:
            term = pa.array(self.terms, type=pa.string()).take(self.best.column("_term").combine_chunks())
            return self.best.drop_columns(["_term"]).add_column(0, "term", term)
        fields = [pa.field("term", pa.string()), *(self.schema or []), pa.field("score", pa.float64())]
        return pa.schema(fields).empty_table()
