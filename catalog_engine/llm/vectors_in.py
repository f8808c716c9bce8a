"""Vectors as the operators on embeddings take them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows at most of a sample that a model of vectors is fitted on.
SAMPLE = 8192


def usable(vector: str) -> Column:
    """Whether a vector has a direction: not null, all components finite, one of them not zero."""
    infinite = F.lit(float("inf"))
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < infinite))
    return F.coalesce(F.col(vector).isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def float_type(df: DataFrame, vector: str) -> str:
    """``float`` where the components are single precision, else ``double``."""
    return "float" if df.schema[vector].dataType.elementType.typeName() == "float" else "double"


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times the power of two by which their largest component is from 1/2 to 1: angles stay, squares are in range."""
    exponent = np.frexp(np.abs(x).max(axis=1, initial=0.0))[1]
    return np.ldexp(x, -exponent[:, None])


def by_size(column: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Rows and their vectors (in double precision) for each number of components."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.diff(column.offsets.to_numpy()) if len(column) else np.empty(0, int)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    starts = np.cumsum(lengths) - lengths
    found = {}
    for size in np.unique(lengths):
        rows = np.flatnonzero(lengths == size)
        found[int(size)] = rows, flat[starts[rows][:, None] + np.arange(size)]
    return found


def sample(df: DataFrame, id_col: str, vector: str, rows: int = SAMPLE) -> dict[int, np.ndarray]:
    """At most ``rows`` usable vectors, those of smallest hash, by their number of components."""
    chosen = df.orderBy(F.xxhash64(F.col(id_col).cast("string")), F.xxhash64(vector)).limit(rows).select(vector)
    table = chosen.toArrow()
    return {size: x for size, (_, x) in by_size(table.column(0)).items()} if table.num_rows else {}
