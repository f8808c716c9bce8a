"""Rule-driven field extraction (E12, M6) and stringified records."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalog_engine.functions import text
from catalog_engine.rules import FieldRule


def field_column(rule: FieldRule) -> Column:
    c = F.col(rule.source)
    if rule.pattern is not None:
        c = F.regexp_extract(c, rule.pattern, rule.group)
    if rule.post is not None:
        c = rule.post(c)
    return text.blank_to_null(c).alias(rule.name)


def extract_fields(df: DataFrame, rules: Iterable[FieldRule], keep: Sequence[Column | str] = ()) -> DataFrame:
    """One projection with a column per rule, followed by ``keep``.

    The same rules serve a whole table and a single new row.
    """
    return df.select(*[field_column(r) for r in rules], *keep)


def stringify(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Every column as text; arrays as list text; missing stays NULL."""
    kinds = dict(df.dtypes)

    def as_text(name: str) -> Column:
        if name not in kinds:
            return F.lit(None).cast("string").alias(name)
        c = F.col(name)
        if kinds[name].startswith("array"):
            quoted = F.transform(c, lambda x: F.concat(F.lit("'"), x.cast("string"), F.lit("'")))
            return F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]")).alias(name)
        return c.cast("string").alias(name)

    return df.select(*[as_text(c) for c in columns])
