"""Reading and publishing tables.

A published table is a folder of versions.  A new state goes to a new version
and becomes visible when Spark's committer has finished it, so a job may read
the present version while it writes the next one, and a failed job leaves the
table as it was.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalog_engine import schema as schemas
from catalog_engine.operators import quality


def read_table(spark: SparkSession, where: str, columns: Sequence[str] | None = None) -> DataFrame:
    """A catalog table by name, or parquet by path; only ``columns`` when given."""
    df = spark.read.parquet(where) if "/" in where else spark.table(where)
    return df.select(*columns) if columns else df


def read_raw_csv(
    spark: SparkSession, path: str, schema: T.StructType = schemas.RAW, multi_line: bool = False
) -> DataFrame:
    """Raw rows from CSV with a header, all text.

    Large files are split over tasks.  Values with line breaks need
    ``multi_line``, which makes every file one task: an export that has them
    should come in many files.
    """
    return spark.read.csv(path, schema=schema, header=True, multiLine=multi_line, quote='"', escape='"')


def write_csv(df: DataFrame, path: str) -> None:
    """CSV export with a header, one file per partition; white space around values stays."""
    kept = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    df.write.mode("overwrite").options(header=True, escape='"', **kept).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object per row, for instance a vocabulary (A5)."""
    df.write.mode("overwrite").json(path)


def inline_rows(spark: SparkSession, rows: Iterable, schema: T.StructType | str, view: str | None = None) -> DataFrame:
    """Hand-entered rows as a table, and as a temporary view when named (S3)."""
    df = spark.createDataFrame(rows, schema)
    if view:
        df.createOrReplaceTempView(view)
    return df


def preview(df: DataFrame, n: int = 10) -> DataFrame:
    """The first rows."""
    return df.limit(n)


# -- versioned tables --------------------------------------------------------


MARKER = "_SUCCESS"


def file_system(spark: SparkSession, root: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def _versions(spark: SparkSession, root: str, finished: bool = True) -> list[int]:
    """Finished versions, or all that were begun, oldest first."""
    fs, path = file_system(spark, root)
    if not fs.exists(path):
        return []
    found = []
    for status in fs.listStatus(path):
        m = re.fullmatch(r"version=(\d+)", status.getPath().getName())
        if m and (not finished or fs.exists(spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), MARKER))):
            found.append(int(m.group(1)))
    return sorted(found)


def _finish(spark: SparkSession, version: str) -> None:
    """Marks a version as finished, whether or not the committer is set to mark its jobs."""
    fs, path = file_system(spark, f"{version}/{MARKER}")
    fs.create(path, True).close()


def current_path(spark: SparkSession, root: str) -> str | None:
    versions = _versions(spark, root)
    return f"{root}/version={versions[-1]}" if versions else None


def read_current(spark: SparkSession, root: str, schema: T.StructType | None = None) -> DataFrame:
    """The present version; an empty table of ``schema`` when there is none yet."""
    path = current_path(spark, root)
    if path is None:
        if schema is None:
            raise FileNotFoundError(f"no published version under {root}")
        return spark.createDataFrame([], schema)
    return spark.read.parquet(path)


def publish(df: DataFrame, root: str, keep_columns: bool = True) -> int:
    """Replace the table's content; returns the number of rows written.

    With ``keep_columns`` a column of the present version that ``df`` lacks
    stays in the table as NULL.
    """
    spark = df.sparkSession
    versions = _versions(spark, root)
    if versions and keep_columns:
        before = read_current(spark, root).schema
        missing = [f for f in before.fields if f.name not in df.columns]
        df = df.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in missing])
    counted, seen = quality.observe_rows(df, "rows")
    # A number that was begun is never used again, finished or not.
    version = max(_versions(spark, root, finished=False), default=0) + 1
    counted.write.mode("error").parquet(f"{root}/version={version}")
    _finish(spark, f"{root}/version={version}")
    return seen.get["rows"]


def append(df: DataFrame, root: str) -> int:
    """Add rows to the present version; returns how many.

    Columns the rows lack are NULL; a column the table lacks is an error, so
    all files of a version have one schema.  The count comes from the write
    itself, so ``df`` is computed once.
    """
    spark = df.sparkSession
    path = current_path(spark, root)
    if path is None:
        if _versions(spark, root, finished=False):
            raise RuntimeError(f"{root} has versions, but none is finished")
        return publish(df, root)
    fields = read_current(spark, root).schema.fields
    unknown = set(df.columns) - {f.name for f in fields}
    if unknown:
        raise ValueError(f"{root} has no column {sorted(unknown)}")
    aligned = df.select(
        *[
            (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in fields
        ]
    )
    counted, seen = quality.observe_rows(aligned, "rows")
    counted.write.mode("append").parquet(path)
    return seen.get["rows"]


def clustered(df: DataFrame, keys: Sequence[str], files: int) -> DataFrame:
    """``df`` in about ``files`` partitions by key ranges, each in key order.

    A hash of the whole row comes last in the ranges, so rows that share one
    hot key can still be split over several files.
    """
    spread = F.xxhash64(*df.columns)
    return df.repartitionByRange(files, *keys, spread).sortWithinPartitions(*keys)


def write_clustered(df: DataFrame, path: str, keys: Sequence[str], files: int) -> None:
    """Files that a lookup by key can skip."""
    clustered(df, keys, files).write.mode("overwrite").parquet(path)


def compact(spark: SparkSession, root: str, keys: Sequence[str], files: int) -> int:
    """The present content as a new, clustered version."""
    return publish(clustered(read_current(spark, root), keys, files), root)


# -- catalog tables ------------------------------------------------------------


def table_exists(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name)


def save_table(
    df: DataFrame,
    name: str,
    key: str | None = None,
    buckets: int = 0,
    path: str | None = None,
    mode: str = "error",
) -> None:
    """``df`` as a catalog table (S1, S6), by a hash of ``key`` in ``buckets`` sorted buckets when given.

    Joins with the table on its key, such as those of keyed jobs, don't shuffle
    it then.  Spark keeps to this while there are at least as many buckets as
    shuffle partitions.  With ``path`` the table is an external one.
    """
    writer = df.write.format("parquet").mode(mode)
    if buckets:
        # One file a bucket: rows come to the writer as they are to be stored.
        writer = df.repartition(buckets, key).write.format("parquet").mode(mode).bucketBy(buckets, key).sortBy(key)
    if path:
        writer = writer.option("path", path)
    writer.saveAsTable(name)


def replace_table(
    df: DataFrame, name: str, key: str | None = None, buckets: int = 0, path: str | None = None
) -> None:
    """``df`` becomes the table's content, also where it reads that very table.

    The new state is written beside the present one, which then gives its name to it.
    A column of the table that ``df`` lacks stays in it as NULL.  Between
    the two statements of the catalog there is no table of the name.
    """
    spark = df.sparkSession
    if not table_exists(spark, name):
        save_table(df, name, key, buckets, path)
        return
    missing = [f for f in spark.table(name).schema.fields if f.name not in df.columns]
    df = df.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in missing])
    following = f"{name}__next"
    spark.sql(f"DROP TABLE IF EXISTS {following}")
    save_table(df, following, key, buckets, path)
    spark.sql(f"DROP TABLE {name}")
    spark.sql(f"ALTER TABLE {following} RENAME TO {name}")


def append_table(df: DataFrame, name: str) -> None:
    """Rows added to a catalog table, by column name (S7); columns they lack are NULL, others than the table's an error."""
    spark = df.sparkSession
    fields = spark.table(name).schema.fields
    unknown = set(df.columns) - {f.name for f in fields}
    if unknown:
        raise ValueError(f"{name} has no column {sorted(unknown)}")
    aligned = df.select(
        *[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields]
    )
    aligned.write.mode("append").insertInto(name)


# -- files that lookups skip -----------------------------------------------------

#: Bytes of a row group of tables that are looked up by key, before compression.
LOOKUP_ROW_GROUP = 16 * 1024 * 1024


def write_lookup(
    df: DataFrame,
    path: str,
    keys: Sequence[str],
    distinct: int,
    row_group_bytes: int = LOOKUP_ROW_GROUP,
    mode: str = "error",
) -> None:
    """Parquet with a Bloom filter of each key in every row group.

    A lookup by equality reads the row groups whose filter may hold the key,
    whatever order the rows are in.  ``distinct`` is the number of distinct keys
    to expect in a row group; about 1.2 bytes are stored for each.  Dictionaries are
    off for the keys: Parquet writes no filter for a column that has one.
    """
    options = {"parquet.block.size": str(row_group_bytes)}
    for key in keys:
        options |= {
            f"parquet.bloom.filter.enabled#{key}": "true",
            f"parquet.bloom.filter.expected.ndv#{key}": str(distinct),
            f"parquet.enable.dictionary#{key}": "false",
        }
    df.write.mode(mode).options(**options).parquet(path)


# -- clustering by several keys ----------------------------------------------------

#: Rows at most that key ranges are found from, and bits of a key's rank.
RANGE_SAMPLE, RANK_BITS = 1 << 15, 6


def key_ranges(df: DataFrame, keys: Sequence[str], bits: int = RANK_BITS) -> dict[str, list]:
    """For each key the values that cut it into 2 ** ``bits`` ranges of about equal size.

    From at most ``RANGE_SAMPLE`` rows, those of smallest hash.  A value that
    fills several ranges is listed once.
    """
    chosen = df.select(*keys).orderBy(F.xxhash64(*df.columns)).limit(RANGE_SAMPLE).collect()
    cuts = {}
    for i, key in enumerate(keys):
        values = sorted(r[i] for r in chosen if r[i] is not None)
        steps = [values[len(values) * k >> bits] for k in range(1, 1 << bits)] if values else []
        cuts[key] = list(dict.fromkeys(steps))
    return cuts


def _rank(c: Column, bounds: list, low: int, high: int) -> Column:
    """How many of ``bounds[low:high]``, which rise, are not above ``c``, plus ``low``; a search by halves."""
    if low == high:
        return F.lit(low)
    middle = (low + high) // 2
    return F.when(c >= F.lit(bounds[middle]), _rank(c, bounds, middle + 1, high)).otherwise(
        _rank(c, bounds, low, middle)
    )


def interleaved(df: DataFrame, cuts: dict[str, list], place: str, bits: int = RANK_BITS) -> DataFrame:
    """``df`` with its Z-order: the bits of the ranks of its keys by turns, highest first.  NULL ranks lowest."""
    ranks = {f"{place}_{i}": F.when(F.col(k).isNull(), 0).otherwise(_rank(F.col(k), b, 0, len(b))) for i, (k, b) in enumerate(cuts.items())}
    ranked, z = df.withColumns(ranks), F.lit(0).cast("long")
    for turn, name in enumerate(ranks):
        for bit in range(bits):
            one = F.shiftright(name, bit).bitwiseAND(F.lit(1)).cast("long")
            z = z + F.shiftleft(one, bit * len(ranks) + len(ranks) - 1 - turn)
    return ranked.withColumn(place, z).drop(*ranks)


def write_zordered(
    df: DataFrame, path: str, keys: Sequence[str], files: int, bits: int = RANK_BITS, mode: str = "overwrite"
) -> None:
    """About ``files`` files that a filter on any of ``keys`` can skip.

    Rows are ordered by the interleaved bits of the keys' ranks; the order within
    a file is that order, too, so that row groups can be skipped.  A hash of the row comes last in the
    ranges: rows that share all keys can still be split.
    """
    place = "_place"
    while place in df.columns:
        place += "_"
    ordered = interleaved(df, key_ranges(df, keys, bits), place, bits)
    ordered = ordered.repartitionByRange(files, place, F.xxhash64(*df.columns)).sortWithinPartitions(place, *keys)
    ordered.drop(place).write.mode(mode).parquet(path)
