"""The tag bag as a SQL function, for callers that write SQL."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import SparkSession

from catalog_engine import rules

# Fixed value: the name SQL callers use.
TAG_FUNCTION = "generate_perfume_string"


def register_tag_function(
    spark: SparkSession, name: str = TAG_FUNCTION, fields: Sequence[tuple[str, str]] = rules.TAG_PREFIXES
) -> None:
    """A temporary function of one text argument per field; same result as ``text.tag_bag``.

    It is a SQL expression, inlined by the optimizer where it is called.
    """

    def tags(prefix: str, arg: str) -> str:
        word = f"concat('{prefix}', translate(trim(x), ' ', '_'))"
        return f"CASE WHEN {arg} <> '' THEN array_join(transform(split({arg}, ','), x -> {word}), ' ') END"

    args = ", ".join(f"{c} STRING" for _, c in fields)
    body = ", ".join(tags(prefix, c) for prefix, c in fields)
    spark.sql(
        f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS STRING "
        f"RETURN trim(concat_ws(' ', {body}))"
    )
