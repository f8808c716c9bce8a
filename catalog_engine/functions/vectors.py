"""Vector column expressions over ``array<float>`` (V1, V2)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dot(a: Column | str, b: Column | str) -> Column:
    """Dot product, summed in double.  Vectors of different lengths give NULL."""
    products = F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column | str) -> Column:
    """Euclidean length (V1)."""
    return F.sqrt(F.aggregate(_col(a), F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine similarity (V2); NULL when either vector has no direction."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def as_floats(a: Column | str) -> Column:
    """Elements cast to float."""
    return F.transform(_col(a), lambda x: x.cast("float"))
