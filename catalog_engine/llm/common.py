"""Small helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

# Bytes of text or of results that a worker holds beyond its Arrow batch.
SLICE_BYTES = 16 * 1024 * 1024


def arrow_schema(schema: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(schema))


def unused_name(df: DataFrame, base: str) -> str:
    """A column name like ``base`` that ``df`` does not have in any case of its letters."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def default_tokenizer(name: str) -> str:
    """Path of an installed public vocabulary file, looked up where it is used."""
    import public_tokenizers

    return public_tokenizers.path(name)


def slices(texts: list, limit: int = SLICE_BYTES) -> Iterator[slice]:
    """Consecutive slices of a batch of about ``limit`` characters, at least one row each."""
    start = held = 0
    for i, text in enumerate(texts):
        if i > start and held + len(text) > limit:
            yield slice(start, i)
            start, held = i, 0
        held += len(text)
    if start < len(texts):
        yield slice(start, len(texts))
