"""Keyed upsert and delete as new table states (M1-M3).

Nothing is changed in place: each function returns the new state, which the
caller publishes with :mod:`catalog_engine.sources.tables`.

NULL keys never match: such source rows are always inserted and such target
rows always kept.  Two source rows with one key are ambiguous and fail the job.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog_engine.operators.keys import HASH, check_types, is_broadcast, is_bucketed, listed, same_key, unlisted, with_hash


def ambiguous_keys(source: DataFrame, key: str) -> DataFrame:
    """No rows, or a failed job when a key occurs twice; shuffles keys only.

    Keys shuffle as a few bytes each, of which Spark would put millions into one
    task; they keep to as many tasks as there are shuffle partitions.
    """
    message = F.lit(f"upsert: more than one source row for one value of {key}")
    keys = with_hash(source.filter(F.col(key).isNotNull()).select(key), key)
    if not is_broadcast(source):
        # By the hash, too: by the key alone they may lie together already, in few tasks.
        keys = keys.repartition(int(source.sparkSession.conf.get("spark.sql.shuffle.partitions")), HASH, key)
    counts = keys.groupBy(HASH, key).count()
    return counts.filter(
        F.when(F.col("count") > 1, F.raise_error(message).cast("boolean")).otherwise(False)
    )


def upsert(
    target: DataFrame,
    source: DataFrame,
    key: str,
    update_cols: Sequence[str] | None = None,
    insert_cols: Sequence[str] | None = None,
    null_keys: bool = True,
) -> DataFrame:
    """New state of ``target`` after merging ``source`` on ``key``.

    Without column lists every target column is taken from the source (M1).
    With them (M2), a matched row takes ``update_cols`` from the source and
    keeps the rest; a new row takes ``insert_cols`` and has NULL elsewhere.
    ``null_keys=False`` says the source has none and saves a pass over it.
    The source's rows are shuffled once, but its keys are looked at several
    times: write a costly source down first.
    """
    check_types(target, source, key)
    kinds = {f.name: f.dataType for f in target.schema.fields}
    keyed = source.filter(F.col(key).isNotNull())

    if update_cols is None and insert_cols is None:
        insert_cols = target.columns
        state = unlisted(target, keyed, key)
        added = keyed
    else:
        update_cols = list(update_cols or ())
        insert_cols = list(insert_cols if insert_cols is not None else [key, *update_cols])
        # The table is read once, on the streamed side: it is not shuffled
        # while the source fits Spark's broadcast limit.
        old, new, same = with_hash(target, key).alias("t"), with_hash(keyed, key).alias("s"), same_key("t", "s", key)
        if is_bucketed(target, key):
            # Rows stored in buckets by the key are joined where they lie.
            old, new, same = target.alias("t"), keyed.alias("s"), F.col(f"t.{key}") == F.col(f"s.{key}")
        matched = F.col(f"s.{key}").isNotNull()
        state = old.join(new, same, "left").select(
            *[
                F.when(matched, F.col(f"s.{c}").cast(kinds[c])).otherwise(F.col(f"t.{c}")).alias(c)
                if c in update_cols
                else F.col(f"t.{c}")
                for c in target.columns
            ]
        )
        # For what to insert, only the table's key column is read again; it
        # meets a broadcast source where it lies, else both are shuffled once.
        known = target.select(key)
        added = unlisted(keyed, listed(known, keyed, key) if is_broadcast(source) else known, key)

    out = state.unionByName(_as_target(target, added, insert_cols))
    if null_keys:
        out = out.unionByName(_as_target(target, source.filter(F.col(key).isNull()), insert_cols))
    return out.unionByName(_as_target(target, ambiguous_keys(source, key), [key]))


def insert_rows(
    target: DataFrame, source: DataFrame, key: str, insert_cols: Sequence[str] | None = None
) -> DataFrame:
    """What an upsert adds when no source key is in ``target`` yet."""
    columns = insert_cols if insert_cols is not None else target.columns
    return _as_target(target, source, columns).unionByName(
        _as_target(target, ambiguous_keys(source, key), [key])
    )


def _as_target(target: DataFrame, df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``df`` in the shape of ``target``; columns not listed are NULL."""
    return df.select(
        *[
            (F.col(f.name) if f.name in columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in target.schema.fields
        ]
    )


def delete_by_key(df: DataFrame, keys: DataFrame, on: str, keys_on: str | None = None) -> DataFrame:
    """``df`` without the rows whose key is listed; rows with a NULL key stay (M3)."""
    return unlisted(df, keys.select(F.col(keys_on or on).alias(on)), on)


def delete_cascade(tables: Mapping[str, tuple[DataFrame, str]], keys: DataFrame) -> dict[str, DataFrame]:
    """The same delete over several tables, each with its own key column.

    ``tables`` maps a name to (table, key column); ``keys`` holds a column for
    every key column used.
    """
    return {name: delete_by_key(df, keys, on) for name, (df, on) in tables.items()}
