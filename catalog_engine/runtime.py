"""Session facts the operators need: the shared folder and size limits."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

# Largest table the driver will hand to every task, in bytes.
BROADCAST_BYTES = 64 * 1024 * 1024


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as named by ``spark.checkpoint.dir``.

    Only a local session, where one machine is the whole cluster, may fall
    back to a temporary folder.
    """
    context = spark.sparkContext
    named, current = spark.conf.get("spark.checkpoint.dir", None), context.getCheckpointDir()
    if not named and not current:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        named = tempfile.mkdtemp(prefix="catalog-engine-")
    if not current:
        context.setCheckpointDir(named)
    return named or current


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder, so that a lost executor re-reads the same rows."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def is_small(df: DataFrame, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether the rows, measured as JSON text, fit ``max_bytes``."""
    row_bytes = F.octet_length(F.to_json(F.struct(*df.columns)))
    return (df.agg(F.sum(row_bytes)).first()[0] or 0) <= max_bytes


def broadcast_if_small(df: DataFrame, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` marked for broadcast when its measured size allows, else as it is.

    Meant for a batch that is written down already: Spark's own estimate of
    one that came out of joins is far too high, and a small batch would make
    it shuffle the whole table it meets.
    """
    return F.broadcast(df) if is_small(df, max_bytes) else df


def written(df: DataFrame, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` written to the shared folder, and marked for broadcast when its size allows.

    The size is measured while it is written, so this is one job.
    """
    seen = Observation()
    row_bytes = F.octet_length(F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns))))
    stored = checkpointed(df.observe(seen, F.coalesce(F.sum(row_bytes), F.lit(0)).alias("bytes")))
    return F.broadcast(stored) if seen.get["bytes"] <= max_bytes else stored


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt to all cores when it is read in fewer partitions than there are, for costly work on each row.

    Few partitions mean a small input, such as one file with one row group; a
    large one, or one that was shuffled, stays as it is.
    """
    if "Exchange" in df._jdf.queryExecution().executedPlan().toString():
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
