"""Keep the best row per key."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Keys whose best row so far a task remembers; 24 bytes each.
REMEMBERED = 1 << 20


def dedupe_best(
    df: DataFrame, keys: Sequence[Column | str], order: Sequence[Column], lead: Column | None = None
) -> DataFrame:
    """One row per key: the first by ``order``.

    ``order`` should end in something unique.  The ``= 1`` filter lets Spark
    keep only the best row per key and map task before the shuffle, so a key
    that holds a large share of the table costs the reducer one row per task.
    The keys' hash leads the sort, so long keys are rarely compared as text.

    That takes a sort of whole rows before the shuffle.  For tables with many
    wide copies per key, ``lead`` tells what most of them lose by: see :func:`unbeaten`.
    """
    if lead is not None:
        df = unbeaten(df, keys, lead)
    window = Window.partitionBy(F.xxhash64(*keys), *keys).orderBy(*order)
    ranked = df.withColumn("_rank", F.row_number().over(window))
    return ranked.filter(F.col("_rank") == 1).drop("_rank")


class Leads:
    """The largest lead seen so far, of up to ``size`` keys; a newer key takes an older one's place."""

    def __init__(self, size: int = REMEMBERED):
        self.keys = np.zeros((2, size), np.int64)
        self.best = np.full(size, np.iinfo(np.int64).min)

    def unbeaten(self, key: np.ndarray, check: np.ndarray, lead: np.ndarray) -> np.ndarray:
        """Which rows no row of their key, in this batch or before, is ahead of; a key is known by both of its hashes."""
        slot = key & (self.best.size - 1)
        rows = np.flatnonzero(~self._beaten(slot, key, check, lead))
        # Of several rows for one place the last is stored, the one of largest lead.
        rows = rows[np.argsort(lead[rows], kind="stable")]
        self.keys[0, slot[rows]], self.keys[1, slot[rows]], self.best[slot[rows]] = key[rows], check[rows], lead[rows]
        return ~self._beaten(slot, key, check, lead)

    def _beaten(self, slot: np.ndarray, key: np.ndarray, check: np.ndarray, lead: np.ndarray) -> np.ndarray:
        return (self.keys[0, slot] == key) & (self.keys[1, slot] == check) & (lead < self.best[slot])


def unbeaten(df: DataFrame, keys: Sequence[Column | str], lead: Column) -> DataFrame:
    """``df`` without rows that another row of the same key and task is ahead of; at least the best rows stay.

    ``lead`` is a bigint without NULLs.  Of two rows of one key, the one with the larger ``lead``
    must come first in the order of the de-duplication.  Rows stream past a table
    of bounded size, of which only hashes and ``lead`` go through Python.
    """
    absent = [F.isnull(k) for k in keys]  # the hash alone skips NULLs
    hashes = [F.xxhash64(F.lit(seed), *keys, *absent) for seed in (1, 2)]

    @F.arrow_udf("boolean")
    def keep(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        leads = Leads()
        for batch in batches:
            yield pa.array(leads.unbeaten(*(c.to_numpy(zero_copy_only=False) for c in batch)))

    # Which rows are dropped depends on what the task has seen: the filter must stay where it is.
    keep = keep.asNondeterministic()(*hashes, lead)
    return df.withColumn("_keep", keep).filter("_keep").drop("_keep")
