"""What is new, stale or unchanged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalog_engine.functions import text
from catalog_engine.operators.keys import listed, unlisted

ADDED, UNEMBEDDED, UNCHANGED, UPDATED = "added", "unembedded", "unchanged", "updated"
REJECTED = "rejected"


def rows_with_text(items: DataFrame, key: str, text_col: str) -> DataFrame:
    """Rows that can be embedded: key present, text neither NULL nor empty (F1)."""
    return items.filter(F.col(key).isNotNull() & (F.col(text_col) != ""))


def rows_in(items: DataFrame, keys: DataFrame, on: str, keys_on: str | None = None) -> DataFrame:
    """Rows whose key is listed in a table of keys (F4, F5); any number, also none."""
    return listed(items, keys.select(F.col(keys_on or on).alias(on)), on)


def new_rows(items: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not stored yet."""
    return unlisted(items, stored, key)


DIGEST = "_digest"


def with_digest(df: DataFrame, text_col: str) -> DataFrame:
    """``df`` plus the text's SHA-256, which stands for the text in joins."""
    return df.withColumn(DIGEST, F.unhex(F.sha2(F.col(text_col), 256)))


def stale_rows(items: DataFrame, stored: DataFrame, key: str, text_col: str) -> DataFrame:
    """Rows with no stored copy of their present text: new ones and changed ones.

    One anti-join on the key and the text's digest, so that of ``stored`` only
    short rows are shuffled and vectors are never read.  A stored NULL text
    counts as changed.
    """
    present = with_digest(items.filter(F.col(text_col).isNotNull()), text_col)
    known = with_digest(stored.select(key, text_col), text_col)
    return unlisted(present, known, key, DIGEST).select(*items.columns)


def existing_state(incoming: DataFrame, clean: DataFrame, stored: DataFrame, key: str, text_col: str) -> DataFrame:
    """``incoming``, one row per key, plus ``in_clean`` and ``stored_text`` (M4).

    Both big tables are first cut down to the incoming keys, and only key and
    text are read from them.
    """
    in_clean = listed(clean.select(key), incoming, key).distinct().withColumn("in_clean", F.lit(True))
    texts = (
        listed(stored.select(key, text_col), incoming, key)
        .groupBy(key)
        .agg(F.min(text_col).alias("stored_text"))
    )
    return (
        incoming.join(in_clean, key, "left")
        .join(texts, key, "left")
        .withColumn("in_clean", F.coalesce("in_clean", F.lit(False)))
    )


def can_embed(key: str, text_col: str) -> Column:
    """Whether a row can get a vector at all: a numeric key and a text that is not empty."""
    return text.to_key(F.col(key).cast("string")).isNotNull() & F.coalesce(F.col(text_col) != "", F.lit(False))


def classify_changes(incoming: DataFrame, clean: DataFrame, stored: DataFrame, key: str, text_col: str) -> DataFrame:
    """``incoming`` plus ``status`` and ``needs_embedding`` (M5); first match wins.

    Texts are compared by digest, so that of ``stored`` only short rows are shuffled.
    """
    known = with_digest(stored.select(key, text_col), text_col).select(key, DIGEST)
    state = existing_state(with_digest(incoming, text_col), clean, known, key, DIGEST)
    status = (
        F.when(~F.col("in_clean"), ADDED)
        .when(F.col("stored_text").isNull(), UNEMBEDDED)
        .when(F.col("stored_text") == F.col(DIGEST), UNCHANGED)
        .otherwise(UPDATED)
    )
    return state.select(
        *incoming.columns, status.alias("status"), (status != UNCHANGED).alias("needs_embedding")
    )
