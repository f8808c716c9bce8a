"""The clean job: raw scraped rows to one typed row per key."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalog_engine import rules
from catalog_engine.functions import text
from catalog_engine.operators.dedupe import dedupe_best
from catalog_engine.operators.extract import extract_fields
from catalog_engine.rules import FieldRule


@dataclass(frozen=True)
class CleanSpec:
    """What to derive (``fields``, ``extra``), which copy to keep, what to tag.

    ``keys`` and ``order`` are looked up in the raw columns when ``best_first``
    is set: losing copies are then dropped before any field is extracted.
    Without it they may use derived columns, and large raw columns that no
    field keeps are gone before the shuffle.  ``lead`` is the start of ``order``
    as a number, see :func:`dedupe_best`.
    """

    fields: Sequence[FieldRule]
    keys: Sequence[Column | str]
    order: Sequence[Column]
    best_first: bool
    extra: Sequence[Column] = ()
    tags: Sequence[tuple[str, str]] = ()
    tag_column: str = "perfume_string"
    drop: Sequence[str] = ()
    lead: Column | None = None


def clean(raw: DataFrame, spec: CleanSpec) -> DataFrame:
    """Keep the best copy per key, extract fields, add the tag bag: one shuffle.

    The same call serves the whole table or a single new row.
    """
    if spec.best_first:
        out = extract_fields(dedupe_best(raw, spec.keys, spec.order, spec.lead), spec.fields, spec.extra)
    else:
        out = dedupe_best(extract_fields(raw, spec.fields, spec.extra), spec.keys, spec.order, spec.lead)
    if spec.tags:
        out = out.withColumn(spec.tag_column, text.tag_bag(spec.tags))
    return out.drop(*spec.drop)


def item_spec(order_as: str = "number", copies: bool = True) -> CleanSpec:
    """The built-in preset.

    The copy with most ratings is kept.  ``order_as="string"`` compares the
    counts as the text they were scraped as.  ``copies=False`` is for rows of which
    hardly any is a copy; it saves a pass that would drop few, and changes no result.
    """
    by_suffix = [text.suffix_category(c, rules.CATEGORY_SUFFIXES) for c in ("name", "gender")]
    labels = [label for _, label in rules.CATEGORY_SUFFIXES]
    category = F.coalesce(*by_suffix, F.when(F.col("gender").isin(labels), F.col("gender")))
    most_rated, lead = {
        "number": (text.to_int("rating_count"), text.int_lead(text.to_int("rating_count"))),
        "string": (F.col("rating_count"), text.text_lead("rating_count")),
    }[order_as]
    ties = ("rating_count", "description", "main_accords", "perfumers", "name", "gender")
    return CleanSpec(
        fields=rules.ITEM_FIELDS,
        extra=(
            text.list_text_entries("perfumers").alias("perfumers"),
            category.alias("gender"),
            text.to_int("rating_count").alias("rating_count"),
            text.to_decimal("rating").alias("rating"),
            text.missing_to_null("description").alias("description"),
            F.col("url"),
        ),
        keys=["url"],
        order=[
            most_rated.desc_nulls_last(),
            text.to_decimal("rating").desc_nulls_last(),
            *[F.asc_nulls_last(c) for c in ties],
        ],
        best_first=True,
        tags=rules.TAG_PREFIXES,
        lead=lead if copies else None,
    )


def clean_items(raw: DataFrame, order_as: str = "number", copies: bool = True) -> DataFrame:
    return clean(raw, item_spec(order_as, copies))
