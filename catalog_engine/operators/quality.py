"""Coverage, sentinel and vector checks (A1-A5, Q1-Q4)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from catalog_engine.functions import text
from catalog_engine.rules import MISSING_MARK


def observe_rows(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """``df`` with a row counter that rides along its next action (A1)."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen


def field_coverage(df: DataFrame, fields: Sequence[str], missing: str = MISSING_MARK) -> DataFrame:
    """Per field: rows passing, rows in total and OK / PARTIAL / BROKEN (A4, Q1)."""
    kinds = dict(df.dtypes)
    counts = df.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(text.field_ok(f, kinds[f], missing)).alias(f) for f in fields],
    )
    return counts.unpivot(["total"], list(fields), "field", "passing").select(
        "field",
        "passing",
        "total",
        F.when(F.col("passing") == F.col("total"), "OK")
        .when(F.col("passing") == 0, "BROKEN")
        .otherwise("PARTIAL")
        .alias("flag"),
    )


def unknown_fields(columns: Sequence[str]) -> Column:
    """The text columns that hold nothing: NULL, empty, a missing mark or an empty list."""
    nothing = ("", "[]", *text.MISSING_MARKS)
    return F.array_compact(
        F.array(*[F.when(F.col(c).isNull() | F.col(c).isin(*nothing), F.lit(c)) for c in columns])
    )


def sentinel_fields(df: DataFrame, columns: Sequence[str], missing: str = MISSING_MARK) -> DataFrame:
    """``df`` plus ``missing_fields``: the columns that hold the missing mark (Q2)."""
    marked = F.array(*[F.when(F.col(c).cast("string") == missing, F.lit(c)) for c in columns])
    return df.withColumn("missing_fields", F.array_compact(marked))


def check_dims(df: DataFrame, vec: str, expected: int | None = None) -> DataFrame:
    """One row of vector health: sizes, missing and wrong-sized vectors (A2, A3, Q3)."""
    size = F.cardinality(vec)
    wrong = F.count_if(size != expected) if expected is not None else F.lit(None).cast("bigint")
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count(vec).alias("embedded"),
        F.min(size).alias("min_dim"),
        F.max(size).alias("max_dim"),
        F.count_if(F.col(vec).isNull()).alias("missing"),
        wrong.alias("wrong_dim"),
    )


def vocabulary(df: DataFrame, columns: Sequence[str], sep: str = ",") -> DataFrame:
    """Distinct entries of comma-list columns, as (field, term) (A5)."""
    lists = F.array(
        *[F.struct(F.lit(c).alias("field"), F.split(c, sep).alias("terms")) for c in columns]
    )
    entries = df.select(F.inline(lists)).select("field", F.explode("terms").alias("term"))
    return entries.select("field", F.trim("term").alias("term")).filter(F.col("term") != "").distinct()
