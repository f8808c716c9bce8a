"""Joins of a big table with a table of keys.

Joins are made on the key and its hash.  The hash column makes Spark shuffle
both sides for this very join, whatever they were partitioned by before, and
only such a join can have a hot key of the big table split at run time.  It
also comes first in the sort order, so long keys with a common start (URLs)
are rarely compared as text.

A table that is stored in buckets by the key is joined on the key alone: it need
not be shuffled at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

COPIES = 8
HASH = "_hash"


def with_hash(df: DataFrame, *keys: str) -> DataFrame:
    return df.withColumn(HASH, F.xxhash64(*[hashable(df, k) for k in keys]))


def hashable(df: DataFrame, key: str) -> Column:
    """Equal whole numbers hash alike, whatever their width."""
    return F.col(key).cast("bigint") if isinstance(df.schema[key].dataType, T.IntegralType) else F.col(key)


def check_types(left: DataFrame, right: DataFrame, *keys: str) -> None:
    """Keys of two tables must have one type, or both be whole numbers."""
    for key in keys:
        a, b = left.schema[key].dataType, right.schema[key].dataType
        if a != b and not (isinstance(a, T.IntegralType) and isinstance(b, T.IntegralType)):
            raise TypeError(f"{key} is {a.simpleString()} in one table and {b.simpleString()} in the other")


def same_key(left: str, right: str, key: str) -> Column:
    """Join condition for two aliased tables made by :func:`with_hash`."""
    return (F.col(f"{left}.{HASH}") == F.col(f"{right}.{HASH}")) & (
        F.col(f"{left}.{key}") == F.col(f"{right}.{key}")
    )


def key_set(df: DataFrame, *keys: str) -> DataFrame:
    """The distinct keys of ``df``, of which up to ``COPIES`` copies may remain.

    Copies are combined before they are shuffled, so a key that holds a large
    share of ``df`` reaches the join as a few rows.
    """
    group = F.pmod(F.spark_partition_id(), F.lit(COPIES)).alias("_group")
    return df.select(*keys, group).distinct().select(*keys)


def is_broadcast(df: DataFrame) -> bool:
    """Whether Spark will send ``df`` to every task of a join: it is marked so, or its estimate fits the limit."""
    spark, execution = df.sparkSession, df._jdf.queryExecution()
    node = execution.analyzed()
    while node.nodeName() != "ResolvedHint" and node.children().size() == 1:
        node = node.children().head()
    if node.nodeName() == "ResolvedHint" and "broadcast" in node.simpleString(100):
        return True
    limit = spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return int(str(execution.optimizedPlan().stats().sizeInBytes())) <= limit


def is_bucketed(df: DataFrame, key: str) -> bool:
    """Whether ``df`` is a stored table, or a projection or filter of one, whose rows lie in buckets by ``key``."""
    plan = df._jdf.queryExecution().optimizedPlan()
    leaves = plan.collectLeaves()
    leaf = leaves.head() if leaves.size() == 1 else None
    if leaf is None or leaf.getClass().getSimpleName() != "LogicalRelation":
        return False
    relation = leaf.relation()
    if relation.getClass().getSimpleName() != "HadoopFsRelation" or relation.bucketSpec().isEmpty():
        return False
    names = relation.bucketSpec().get().bucketColumnNames()
    if names.size() != 1 or names.head().lower() != key.lower():
        return False
    # The column is still the stored one.
    ids = [
        {a.exprId().toString() for a in map(output.apply, range(output.size())) if a.name().lower() == key.lower()}
        for output in (leaf.output(), plan.output())
    ]
    return bool(ids[0] & ids[1])


def listed(df: DataFrame, keys: DataFrame, *on: str) -> DataFrame:
    """Rows of ``df`` whose key occurs in ``keys``."""
    return _filtered(df, keys, on, "left_semi")


def unlisted(df: DataFrame, keys: DataFrame, *on: str) -> DataFrame:
    """Rows of ``df`` whose key does not occur in ``keys``; NULL keys never do."""
    return _filtered(df, keys, on, "left_anti")


def _filtered(df: DataFrame, keys: DataFrame, on: tuple[str, ...], how: str) -> DataFrame:
    check_types(df, keys, *on)
    if len(on) == 1 and is_bucketed(df, *on):
        return df.join(key_set(keys, *on), list(on), how)
    if len(on) == 1 and is_bucketed(keys, *on):
        return df.join(keys.select(*on), list(on), how)
    right = with_hash(key_set(keys, *on), *on)
    return with_hash(df, *on).join(right, [HASH, *on], how).select(*df.columns)
