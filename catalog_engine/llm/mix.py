"""Mixing sources to target weights with Efraimidis-Spirakis sampling.

Every document gets the exponential key -ln(u) / q, u from a hash of its id and text
and q its quality weight; sorted by key, the first documents of a source are a
weighted sample without replacement.  A source's budget is its target in words:
first every document as often as it fits whole (complete epochs), then the
documents of smallest key whose sizes, summed up in key order, stay within
what is left.  What the document at the cut leaves over is filled the same way
from the smaller documents behind it, ``FILLS`` times.

Only DataFrame functions.  No source is sorted in one task: sizes are summed by
source and key bin, prefix sums run over at most ``BINS`` rows a source, and
only the documents of the one bin that holds the cut are put in order.
Identical rows are counted before anything is sorted.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalog_engine import runtime

#: Sources by code point, null last, have these weights in turn.
WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
BINS = 1 << 16
FILLS = 3
SEED = "mix-1"
WORD = r"[^\x20\x09-\x0D]+"
#: Signs that running text holds few of.
SYMBOLS = "#$%&*|!<>{}[]^~=_"


def words(text: Column) -> Column:
    """Words of a text: runs without white space; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def symbol_quality(text: Column) -> Column:
    """A quality weight from 0.05 to 1: less, the more of the text are symbols."""
    share = 1 - F.char_length(F.translate(text, SYMBOLS, "")) / F.nullif(F.char_length(text), F.lit(0))
    return F.greatest(F.lit(0.05), F.coalesce(1 - 3 * share, F.lit(0.05)))


def uniform(key: Column, text: Column, seed: str = SEED) -> Column:
    """A number in (0, 1) from a hash of ``key`` and ``text``.

    Documents without an id, or of one id, have numbers of their own by their texts.
    """
    own = F.md5(F.coalesce(text, F.lit("")).cast("binary"))
    digest = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(key.cast("string"), F.lit("")), own))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def targets(sized: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``source, source_size, target`` of each source of ``sized`` (source, size).

    Targets share the sum of all sizes by weight; none is above ``max_epochs``
    times its source's size, and the excess goes to the others by weight.  With
    sources in order of cap / weight, the first ones reach their caps and the
    rest share what is left: one pass over one row a source.
    """
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    named = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(named) - 1, F.lit(len(weights)))
    weight = functools.reduce(
        lambda c, i: c.when(turn == i, float(weights[i])), range(1, len(weights)), F.when(turn == 0, float(weights[0]))
    )
    capped = by_source.withColumn("w", weight).withColumn("cap", max_epochs * F.col("source_size"))
    by_cap = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    rest = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    shared = F.sum("w").over(by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    level = capped.withColumn("level", rest / shared)
    open_level = F.min(F.when(F.col("cap") / F.col("w") > F.col("level"), F.struct(F.col("cap") / F.col("w"), "level")))
    return level.withColumn("open", open_level.over(everything)["level"]).select(
        "source",
        "source_size",
        F.least(F.col("cap").cast("double"), F.coalesce(F.col("open") * F.col("w"), F.col("cap").cast("double"))).alias(
            "target"
        ),
    )


def _fill(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """``rows`` (source, bin, z, id, h, size, n, k) with ``k`` raised by the copies that fit ``budgets`` (source, left)."""
    left = rows.join(F.broadcast(budgets), rows["source"].eqNullSafe(budgets["b_source"]), "left").drop("b_source")
    more = F.col("n") - F.col("k")
    fits = (F.col("size") > 0) & (F.col("size") <= F.col("left")) & (more > 0)
    asked = left.withColumn("ask", F.when(fits, more * F.col("size")).otherwise(F.lit(0)))
    binned = asked.filter("ask > 0").groupBy("source", "bin", "left").agg(F.sum("ask").alias("asked"))
    upto = F.sum("asked").over(
        Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    # The bin that the budget ends in: the first whose sum passes it.
    cut = (
        binned.withColumn("upto", upto)
        .filter(F.col("upto") > F.col("left"))
        .groupBy("source")
        .agg(F.min(F.struct("bin", (F.col("upto") - F.col("asked")).alias("before"))).alias("c"))
        .select(F.col("source").alias("c_source"), F.col("c.bin").alias("c_bin"), F.col("c.before").alias("c_before"))
    )
    placed = asked.join(F.broadcast(cut), asked["source"].eqNullSafe(cut["c_source"]), "left").drop("c_source")
    whole = F.col("c_bin").isNull() | (F.col("bin") < F.col("c_bin"))
    at_cut = F.col("bin") == F.col("c_bin")
    ordered = Window.partitionBy("source", "bin").orderBy("z", "id", "h", "size")
    before = F.col("c_before") + F.coalesce(
        F.sum("ask").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    names = ["source", "bin", "z", "id", "h", "size", "n"]
    ask = F.col("ask") > 0
    sure = placed.filter(F.coalesce(~at_cut, F.lit(True)) | ~ask).select(
        *names, (F.col("k") + F.when(ask & whole, more).otherwise(F.lit(0))).alias("k")
    )
    room = F.floor((F.col("left") - before) / F.col("size"))
    split = placed.filter(at_cut & ask).select(
        *names, (F.col("k") + F.greatest(F.lit(0), F.least(more, room))).cast("long").alias("k")
    )
    return sure.unionByName(split)


def decide(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    quality: Column | None = None,
    weights=WEIGHTS,
    max_epochs: int = MAX_EPOCHS,
    seed: str = SEED,
) -> DataFrame:
    """One row per distinct (id, source, text): ``id, source, h, size, source_size, target, n, epochs, k``.

    ``n`` rows of the table are this one; each is taken ``epochs`` times, and
    ``k`` of them once more.  ``h`` is a hash of the text.  Null texts have size
    0 and are never taken; null ids, sources and texts are values of their own;
    an empty table gives an empty one.
    """
    text = F.col(text_col)
    weight = symbol_quality(text) if quality is None else quality
    key = -F.log(uniform(F.col(id_col), text, seed)) / weight
    rows = df.select(
        F.col(id_col).alias("id"),
        F.col(source_col).alias("source"),
        F.xxhash64(text).alias("h"),
        words(text).alias("size"),
        key.alias("key"),
    )
    rows = rows.withColumn("z", F.col("key") / (F.col("key") + 1)).drop("key")
    rows = rows.groupBy("id", "source", "h", "size", "z").agg(F.count(F.lit(1)).alias("n"))
    rows = runtime.checkpointed(rows.withColumn("bin", F.floor(F.col("z") * BINS)))
    aims = runtime.checkpointed(
        targets(rows.select("source", (F.col("size") * F.col("n")).alias("size")), weights, max_epochs).withColumn(
            "epochs", F.coalesce(F.floor(F.col("target") / F.nullif(F.col("source_size"), F.lit(0))), F.lit(0))
        )
    )
    budget = F.col("target") - F.col("epochs") * F.col("source_size")
    budgets = aims.select(F.col("source").alias("b_source"), budget.alias("left"))
    taken = rows.withColumn("k", F.lit(0).cast("long"))
    for _ in range(FILLS):
        taken = runtime.checkpointed(_fill(taken, budgets))
        used = taken.groupBy("source").agg(F.sum(F.col("k") * F.col("size")).alias("used"))
        budgets = aims.join(used.withColumnRenamed("source", "u_source"), F.col("source").eqNullSafe(F.col("u_source"))).select(
            F.col("source").alias("b_source"), (budget - F.col("used")).alias("left")
        )
    return (
        taken.join(
            F.broadcast(aims.withColumnRenamed("source", "a_source")), F.col("source").eqNullSafe(F.col("a_source"))
        )
        .select("id", "source", "h", "size", "source_size", "target", "n", "epochs", "k")
    )


def mix_report(df: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """One row per row of ``df``: the id, ``size, source_size, target, taken``."""
    copy = F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))
    return (
        decide(df, id_col, **options)
        .withColumn("copy", copy)
        .select(
            F.col("id").alias(id_col),
            "size",
            "source_size",
            "target",
            (F.col("size") * (F.col("epochs") + (F.col("copy") <= F.col("k")).cast("int"))).cast("long").alias("taken"),
        )
    )


def mixed(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options
) -> DataFrame:
    """The rows of ``df`` that the mix takes, each as often as it takes them; same columns.

    Where only some of a group of identical rows are taken once more, any row
    with that id, source and text stands for them.
    """
    plan = decide(df, id_col, text_col, source_col, **options).select(
        F.col("id").alias("m_id"), F.col("h").alias("m_h"), F.col("source").alias("m_source"), "n", "epochs", "k"
    )
    plan = plan.filter((F.col("epochs") > 0) | (F.col("k") > 0)).select(
        "m_id", "m_h", "m_source", F.struct("n", "epochs", "k").alias("m_plan")
    )
    keyed = df.select(F.struct(*df.columns).alias("row"), F.xxhash64(text_col).alias("h"))
    rows = keyed.join(
        plan,
        F.col(f"row.{id_col}").eqNullSafe(F.col("m_id"))
        & (F.col("h") == F.col("m_h"))
        & F.col(f"row.{source_col}").eqNullSafe(F.col("m_source")),
    ).drop("h")
    partial = (F.col("m_plan.k") > 0) & (F.col("m_plan.k") < F.col("m_plan.n"))
    times = F.col("m_plan.epochs") + (F.col("m_plan.k") == F.col("m_plan.n")).cast("long")
    whole = rows.select("row", times.alias("times"))
    some = rows.filter(partial).dropDuplicates(["m_id", "m_h", "m_source"]).select("row", F.col("m_plan.k").alias("times"))
    return (
        whole.unionByName(some)
        .filter("times > 0")
        .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
        .select("row.*")
    )


SQL = rf"""
WITH sized AS (
    SELECT doc_id, source, text, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size,
        -ln((('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656)
        / greatest(0.05, coalesce(1 - 3 * (1 - length(translate(text, '{SYMBOLS}', '')) / nullif(length(text), 0)), 0.05)) AS key
    FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
s1 AS (SELECT *, 3 * source_size AS cap,
    CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2 ELSE 1 END AS w FROM s0),
s2 AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
    / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s1),
s3 AS (SELECT *, (SELECT level FROM s2 x WHERE x.cap / x.w > x.level ORDER BY x.cap / x.w, level LIMIT 1) AS open FROM s2),
s4 AS (SELECT source, source_size, least(cap::DOUBLE, coalesce(open * w, cap::DOUBLE)) AS target FROM s3),
aims AS (SELECT *, coalesce(floor(target / nullif(source_size, 0)), 0) AS epochs FROM s4),
p0 AS (SELECT d.*, source_size, target, epochs, target - epochs * source_size AS budget
    FROM sized d JOIN aims a ON d.source IS NOT DISTINCT FROM a.source),
p1 AS (SELECT *, size > 0 AND size <= budget AND sum(CASE WHEN size > 0 AND size <= budget THEN size ELSE 0 END)
    OVER (PARTITION BY source ORDER BY key, doc_id ROWS UNBOUNDED PRECEDING) <= budget AS t1 FROM p0),
p2 AS (SELECT *, budget - coalesce(sum(size) FILTER (t1) OVER (PARTITION BY source), 0) AS left2 FROM p1),
p3 AS (SELECT *, NOT t1 AND size > 0 AND size <= left2 AND sum(CASE WHEN NOT t1 AND size > 0 AND size <= left2 THEN size ELSE 0 END)
    OVER (PARTITION BY source ORDER BY key, doc_id ROWS UNBOUNDED PRECEDING) <= left2 AS t2 FROM p2),
p4 AS (SELECT *, left2 - coalesce(sum(size) FILTER (t2) OVER (PARTITION BY source), 0) AS left3 FROM p3),
p5 AS (SELECT *, NOT t1 AND NOT t2 AND size > 0 AND size <= left3 AND
    sum(CASE WHEN NOT t1 AND NOT t2 AND size > 0 AND size <= left3 THEN size ELSE 0 END)
    OVER (PARTITION BY source ORDER BY key, doc_id ROWS UNBOUNDED PRECEDING) <= left3 AS t3 FROM p4)
SELECT doc_id, size, source_size, target,
    (size * (epochs + CASE WHEN t1 OR t2 OR t3 THEN 1 ELSE 0 END))::BIGINT AS taken
FROM p5
"""
