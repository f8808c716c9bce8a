"""Comparing the rows of a bucket with each other, however large the bucket is.

A bucket of more than ``size`` rows is dealt into parts by a hash of the row's id, and
every pair of parts is a block of its own, so that no task ever holds
more than two parts.  Rows are sent once per part of their bucket; blocks reduce
their pairs before anything leaves them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog_engine import runtime


def paired(rows: DataFrame, keys: list[str], id_col: str, size: int, counts: DataFrame | None = None) -> DataFrame:
    """``rows`` with ``p, q, s``: each row in all blocks (p, q) of its bucket that its part ``s`` belongs to.

    ``counts`` (keys and ``count``) may be given when it is known already.
    """
    counts = rows.groupBy(*keys).count() if counts is None else counts
    large = counts.filter(F.col("count") > size).select(*keys, F.ceil(F.col("count") / size).cast("int").alias("parts"))
    large = runtime.broadcast_if_small(runtime.checkpointed(large))
    parts = F.coalesce(F.col("parts"), F.lit(1))
    dealt = rows.join(large, keys, "left").withColumn("parts", parts)
    dealt = dealt.withColumn("s", F.pmod(F.xxhash64(id_col), F.col("parts")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    return dealt.withColumn("u", other).select(
        *rows.columns, F.least("s", "u").alias("p"), F.greatest("s", "u").alias("q"), "s"
    )


def gathered(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of a block side by side, for ``groups``."""
    return rows.repartition(*keys).sortWithinPartitions(*keys)


def groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """The blocks of a task whose rows are sorted by their first ``keys`` columns, which are whole numbers."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if held is None else pa.concat_tables([held, table])
        ends = boundaries(table, keys)
        for start, end in zip(ends[:-2], ends[1:-1]):
            yield table.slice(start, end - start)
        held = table.slice(ends[-2], ends[-1] - ends[-2]) if len(ends) > 1 else None
    if held is not None and held.num_rows:
        yield held


def boundaries(table: pa.Table, keys: int) -> list[int]:
    n = table.num_rows
    if not n:
        return [0]
    changed = np.zeros(n - 1, bool)
    for k in range(keys):
        values = table.column(k).to_numpy()
        changed |= values[1:] != values[:-1]
    return [0, *(np.flatnonzero(changed) + 1).tolist(), n]


class Forest:
    """Union-find over the rows of one block."""

    def __init__(self, labels: np.ndarray):
        #: Rows with equal labels are together from the start.
        _, self.of = np.unique(labels, return_inverse=True)

    def apart(self, i: int, among: np.ndarray) -> np.ndarray:
        return among[self.of[among] != self.of[i]]

    def together(self, i: int, j: int) -> bool:
        return self.of[i] == self.of[j]

    def join(self, i: int, j: int) -> None:
        self.of[self.of == self.of[j]] = self.of[i]
