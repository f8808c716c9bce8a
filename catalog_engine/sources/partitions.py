"""Stored tables that a change rewrites in part only.

The table is parquet, partitioned by a hash of its key: ``root/key_hash_64=17/...``
for 64 partitions.  A change reads the partitions that hold one of its keys, and
writes them with Spark's dynamic partition overwrite: the other partitions and their
files stay as they are.  New files are moved into place when the job
commits, so a change may read what it replaces, and a job that fails before leaves
the table as it was.  One job at a time may change a table.

With many more partitions than a batch has keys, a batch rewrites little more than
its own partitions; one that meets all of them rewrites the table.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalog_engine.operators.keys import hashable
from catalog_engine.sources.tables import file_system

NAMED = re.compile(r"key_hash_(\d+)=(\d+)")


def column(partitions: int) -> str:
    """The stored column; its name holds the number of partitions, which can't change."""
    return f"key_hash_{partitions}"


def partition_of(df: DataFrame, key: str, partitions: int) -> Column:
    """The partition of a row; rows without a key share one."""
    return F.pmod(F.xxhash64(hashable(df, key)), F.lit(partitions)).cast("int")


def met_by(keys: DataFrame, key: str, partitions: int) -> list[int]:
    """The partitions that hold the keys: at most ``partitions`` numbers."""
    return sorted(r[0] for r in keys.select(partition_of(keys, key, partitions)).distinct().collect())


def folders(spark: SparkSession, root: str) -> dict[tuple[int, int], str]:
    """The path of every stored partition by the number of partitions and its own number."""
    fs, path = file_system(spark, f"{root}/key_hash_*")
    names = [s.getPath().toString() for s in fs.globStatus(path) or ()]
    return {(int(m[1]), int(m[2])): name for name in names if (m := NAMED.search(name))}


def read(
    spark: SparkSession, root: str, schema: T.StructType, partitions: int, only: Iterable[int] | None = None
) -> DataFrame:
    """The table's rows, or those of ``only`` some partitions; an empty table of ``schema`` when there are none.

    A column that some partitions lack is NULL there.
    """
    stored = folders(spark, root)
    _check(stored, root, partitions)
    if not stored:
        return spark.createDataFrame([], schema)
    df = spark.read.option("mergeSchema", "true").parquet(root)
    if only is not None:
        df = df.filter(F.col(column(partitions)).isin(list(only)))
    return df.drop(column(partitions))


def _check(stored: dict[tuple[int, int], str], root: str, partitions: int) -> None:
    other = {n for n, _ in stored} - {partitions}
    if other:
        raise ValueError(f"{root} has {other.pop()} partitions, not {partitions}")


def _write(df: DataFrame, root: str, key: str, partitions: int, mode: str) -> tuple[int, set[int]]:
    """Rows into their partitions; Spark splits large ones and joins small ones before it writes."""
    seen, name = Observation(), column(partitions)
    if name in df.columns:
        raise ValueError(f"{name} is the name of the stored hash")
    dealt = df.withColumn(name, partition_of(df, key, partitions)).hint("rebalance", name)
    dealt = dealt.observe(seen, F.count(F.lit(1)).alias("rows"), F.collect_set(name).alias("partitions"))
    writer = dealt.write.mode(mode).option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(name).parquet(root)
    return seen.get["rows"], set(seen.get["partitions"])


def overwrite(df: DataFrame, root: str, key: str, partitions: int, met: Iterable[int] | None = None) -> int:
    """``df`` becomes the content of the partitions ``met``, by default of the whole table; returns its rows.

    Only partitions of ``met`` may occur in ``df``; those that get no row are
    removed.  A stored column that ``df`` lacks stays in the table, as NULL.
    """
    spark = df.sparkSession
    stored = folders(spark, root)
    _check(stored, root, partitions)
    if stored:
        known = read(spark, root, df.schema, partitions).schema.fields
        df = df.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in known if f.name not in df.columns])
    rows, written = _write(df, root, key, partitions, "overwrite")
    gone = {p for _, p in stored} if met is None else set(met)
    for p in gone - written:
        if (partitions, p) in stored:
            fs, path = file_system(spark, stored[partitions, p])
            fs.delete(path, True)
    return rows


def append(df: DataFrame, root: str, key: str, partitions: int) -> int:
    """Add rows to their partitions; nothing is rewritten.  Returns how many.

    Columns the rows lack are NULL; a column the table lacks is an error.
    """
    spark = df.sparkSession
    stored = folders(spark, root)
    _check(stored, root, partitions)
    if stored:
        fields = read(spark, root, df.schema, partitions).schema.fields
        unknown = set(df.columns) - {f.name for f in fields}
        if unknown:
            raise ValueError(f"{root} has no column {sorted(unknown)}")
        df = df.select(
            *[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields]
        )
    return _write(df, root, key, partitions, "append")[0]
