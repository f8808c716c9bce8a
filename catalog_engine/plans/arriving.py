"""Ingest of files as they arrive (P3, P6), without a job that stays up.

A run takes the files that no run before it has taken, in batches of bounded size,
and ends.  Spark numbers the batches and remembers what each of them holds in
the checkpoint folder, so that a run which failed repeats its last batch with the same
files.  A batch whose report is finished is not ingested again; one that
failed half-way is, which is harmless, as ingesting is an upsert of whole records:
only its report may then call records unchanged that it had changed before.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from catalog_engine.operators.encode import Model
from catalog_engine.plans import jobs
from catalog_engine.sources.tables import MARKER, file_system

#: Files of one batch.
FILES = 1000


def report_path(reports: str, number: int) -> str:
    return f"{reports.rstrip('/')}/batch={number}"


def is_done(spark: SparkSession, reports: str, number: int) -> bool:
    fs, path = file_system(spark, f"{report_path(reports, number)}/{MARKER}")
    return fs.exists(path)


def ingest_batch(
    store: jobs.Store, batch: DataFrame, number: int, encoder: Callable[[], Model], reports: str
) -> bool:
    """Ingest one numbered batch of records and write its report; False when that was done before."""
    spark = batch.sparkSession
    if is_done(spark, reports, number):
        return False
    report = jobs.run_ingest(spark, store, batch, encoder)
    report.write.mode("overwrite").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").parquet(
        report_path(reports, number)
    )
    return True


def run_arriving(
    spark: SparkSession,
    store: jobs.Store,
    folder: str,
    schema: T.StructType | str,
    encoder: Callable[[], Model],
    checkpoint: str,
    reports: str,
    file_format: str = "parquet",
    files_per_batch: int = FILES,
) -> int:
    """Ingest what has arrived in ``folder`` since the last run; returns the number of batches.

    ``schema`` names the columns of the records (see ``ingest.prepare``).
    ``checkpoint`` and ``reports`` belong to this folder and store, and stay.
    """
    arrived = (
        spark.readStream.schema(schema)
        .format(file_format)
        .option("maxFilesPerTrigger", files_per_batch)
        .load(folder)
    )
    done = []

    def one(batch: DataFrame, number: int) -> None:
        done.append(ingest_batch(store, batch, number, encoder, reports))

    query = (
        arrived.writeStream.foreachBatch(one)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return sum(done)


def read_reports(spark: SparkSession, reports: str) -> DataFrame:
    """A row per ingested record, with the number of its batch."""
    return spark.read.parquet(reports)
