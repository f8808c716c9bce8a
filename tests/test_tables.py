"""De-duplication, upserts, deletes, change classification and stored tables."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalog_engine import runtime
from catalog_engine.operators import changes, quality
from catalog_engine.operators.dedupe import dedupe_best
from catalog_engine.operators.upsert import delete_by_key, delete_cascade, upsert
from catalog_engine.sources import tables as store


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# -- dedupe ------------------------------------------------------------------


def test_best_row_per_key_with_a_hot_key(spark):
    df = spark.range(3000).select(
        F.when(F.col("id") < 1000, 0).otherwise(F.col("id")).alias("k"), (F.col("id") % 7).alias("v"), "id"
    )
    best = dedupe_best(df, ["k"], [F.desc("v"), F.asc("id")])
    assert best.columns == ["k", "v", "id"]
    assert best.count() == 2001
    assert tuple(best.filter("k = 0").first()) == (0, 6, 6)
    plan = best._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2  # once before the shuffle


# -- upsert ------------------------------------------------------------------

T_SCHEMA = "id long, a string, b string"


@pytest.fixture
def target(spark):
    return spark.createDataFrame([(1, "a1", "b1"), (2, "a2", "b2"), (None, "an", "bn")], T_SCHEMA)


def test_upsert_all_columns(spark, target):
    source = spark.createDataFrame([("B2", 2, "A2"), ("B3", 3, "A3"), ("BN", None, "AN")], "b string, id long, a string")
    assert rows(upsert(target, source, "id")) == sorted(
        [(1, "a1", "b1"), (2, "A2", "B2"), (3, "A3", "B3"), (None, "an", "bn"), (None, "AN", "BN")], key=repr
    )


def test_upsert_some_columns(spark, target):
    source = spark.createDataFrame([(2, None), (3, "A3")], "id int, a string")
    got = upsert(target, source, "id", update_cols=["a"])
    assert got.schema.simpleString() == target.schema.simpleString()
    assert rows(got) == sorted([(1, "a1", "b1"), (2, None, "b2"), (3, "A3", None), (None, "an", "bn")], key=repr)


def test_update_and_insert_columns_differ(spark, target):
    source = spark.createDataFrame([(2, "A2", "B2"), (3, "A3", "B3")], T_SCHEMA)
    got = upsert(target, source, "id", update_cols=["a"], insert_cols=["id", "b"])
    assert rows(got) == sorted([(1, "a1", "b1"), (2, "A2", "b2"), (3, None, "B3"), (None, "an", "bn")], key=repr)


def test_updating_the_key_column_is_harmless(spark, target):
    source = spark.createDataFrame([(2, "A2")], "id long, a string")
    got = upsert(target, source, "id", update_cols=["id", "a"])
    assert rows(got) == sorted([(1, "a1", "b1"), (2, "A2", "b2"), (None, "an", "bn")], key=repr)


def test_key_types_must_agree(spark, target):  # D6
    source = spark.createDataFrame([("2", "x")], "id string, a string")
    with pytest.raises(TypeError, match="id is"):
        upsert(target, source, "id", update_cols=["a"])
    narrow = spark.createDataFrame([(2,)], "id short")
    assert changes.rows_in(target, narrow, "id").count() == 1
    assert changes.new_rows(target, narrow, "id").count() == 2


def test_null_key_inserts(spark, target):
    source = spark.createDataFrame([(None, "x")], "id long, a string")
    assert upsert(target, source, "id", update_cols=["a"]).count() == 4


@pytest.mark.parametrize("cols", [None, ["a"]])
def test_ambiguous_source_fails(spark, target, cols):
    source = spark.createDataFrame([(2, "x", "y"), (2, "x", "z")], T_SCHEMA)
    with pytest.raises(Exception, match="more than one source row"):
        upsert(target, source, "id", update_cols=cols).collect()


def test_target_copies_are_all_updated(spark):
    target = spark.createDataFrame([(1, "a", "b"), (1, "c", "d")], T_SCHEMA)
    source = spark.createDataFrame([(1, "x")], "id long, a string")
    assert rows(upsert(target, source, "id", update_cols=["a"])) == [(1, "x", "b"), (1, "x", "d")]


@pytest.mark.parametrize("cols", [None, ["a", "b"]])
def test_upsert_twice_changes_nothing(spark, target, cols):
    source = spark.createDataFrame([(2, "A", "B"), (9, "C", "D")], T_SCHEMA)
    once = upsert(target, source, "id", update_cols=cols)
    assert rows(upsert(once, source, "id", update_cols=cols)) == rows(once)


def test_empty_source(spark, target):
    source = spark.createDataFrame([], T_SCHEMA)
    assert rows(upsert(target, source, "id")) == rows(target)
    assert rows(upsert(target, source, "id", update_cols=["a"])) == rows(target)


def test_target_is_not_shuffled_for_a_small_source(spark, tmp_path):
    spark.range(1000).select("id", F.lit("a").alias("a"), F.lit("b").alias("b")).write.parquet(str(tmp_path / "t"))
    spark.range(10).select("id", F.lit("x").alias("a")).write.parquet(str(tmp_path / "s"))
    target, source = spark.read.parquet(str(tmp_path / "t")), spark.read.parquet(str(tmp_path / "s"))
    merged = target.alias("t").join(source.alias("s"), F.col("t.id") == F.col("s.id"), "left")
    assert "BroadcastHashJoin" in merged._jdf.queryExecution().executedPlan().toString()
    got = upsert(target, source, "id", update_cols=["a"])
    assert got._jdf.queryExecution().executedPlan().toString().count("SortMergeJoin") == 0
    assert got.filter("a = 'x'").count() == 10


def test_a_small_batch_of_joins_does_not_shuffle_the_table(spark, tmp_path):
    spark.range(1000).select("id", F.lit("a").alias("a"), F.lit("b").alias("b")).write.parquet(str(tmp_path / "t"))
    target = spark.read.parquet(str(tmp_path / "t"))
    batch = target.join(target.select("id"), "id").filter("id < 5").select("id", F.lit("x").alias("a"))
    batch = runtime.checkpointed(batch)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        def plan(source):
            df = upsert(target, source, "id", update_cols=["a"], null_keys=False)
            assert df.filter("a = 'x'").count() == 5 and df.count() == 1000
            return df._jdf.queryExecution().executedPlan().toString()

        sized = plan(runtime.broadcast_if_small(batch))
        assert "BroadcastHashJoin" in sized and "LeftOuter, BuildRight" in sized
        assert "SortMergeJoin" in plan(runtime.broadcast_if_small(batch, max_bytes=10))
        assert "LeftOuter, BuildRight" not in plan(batch)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_a_hot_key_is_split(spark, tmp_path):
    hot = spark.range(200_000).select(
        F.when(F.col("id") < 70_000, -1).otherwise(F.col("id")).alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("v")
    )
    hot.write.parquet(str(tmp_path / "hot"))
    hot = spark.read.parquet(str(tmp_path / "hot"))
    once = hot.groupBy("k").agg(F.lit("x").alias("v"))  # already partitioned by key
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.shuffle.partitions": "32",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1m",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1m",
    }
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        for df in (changes.rows_in(hot, once, "k"), upsert(hot, once, "k", ["v"]), upsert(hot, once, "k")):
            counted = df.agg(F.count("k"), F.max("v"))
            counted.collect()
            assert "skew=true" in counted._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_delete(spark, target):
    keys = spark.createDataFrame([(1,), (1,), (7,)], "k long")
    assert rows(delete_by_key(target, keys, "id", "k")) == [(2, "a2", "b2"), (None, "an", "bn")]
    left = delete_cascade({"x": (target, "id"), "y": (target, "a")}, spark.createDataFrame([(1, "a2")], "id long, a string"))
    assert rows(left["x"]) == [(2, "a2", "b2"), (None, "an", "bn")]
    assert rows(left["y"]) == [(1, "a1", "b1"), (None, "an", "bn")]


# -- changes -----------------------------------------------------------------


def test_statuses(spark):
    incoming = spark.createDataFrame([(k, "s") for k in "abcde"], "id string, s string")
    clean = spark.createDataFrame([(k,) for k in "bcdee"], "id string")
    stored = spark.createDataFrame([("c", None), ("d", "s"), ("e", "t")], "id string, s string")
    got = changes.classify_changes(incoming, clean, stored, "id", "s")
    assert rows(got.select("id", "status", "needs_embedding")) == [
        ("a", "added", True),
        ("b", "unembedded", True),
        ("c", "unembedded", True),
        ("d", "unchanged", False),
        ("e", "updated", True),
    ]


def test_stale_rows(spark):  # D7
    items = spark.createDataFrame([(1, "s"), (2, "s"), (3, "s"), (4, "s"), (5, None)], "id long, s string")
    stored = spark.createDataFrame([(1, "s"), (2, "t"), (3, None)], "id long, s string")
    assert rows(changes.stale_rows(items, stored, "id", "s")) == [(2, "s"), (3, "s"), (4, "s")]


def test_new_rows_and_no_stored_rows(spark):  # D9
    items = spark.createDataFrame([(1, "s"), (2, "s")], "id long, s string")
    empty = spark.createDataFrame([], "id long, s string")
    assert changes.new_rows(items, empty, "id").count() == 2
    assert changes.new_rows(items, items, "id").count() == 0
    assert changes.rows_in(items, empty, "id").count() == 0


def test_rows_with_text(spark):  # D8
    items = spark.createDataFrame([(1, "s"), (2, ""), (3, None), (None, "s")], "id long, s string")
    assert rows(changes.rows_with_text(items, "id", "s")) == [(1, "s")]


# -- quality -----------------------------------------------------------------


def test_coverage(spark):
    df = spark.createDataFrame(
        [("a", "N/A", ["x"], "q"), ("b", None, [], "q")], "n string, g string, l array<string>, r string"
    )
    assert rows(quality.field_coverage(df, ["n", "g", "l", "r"])) == [
        ("g", 0, 2, "BROKEN"),
        ("l", 1, 2, "PARTIAL"),
        ("n", 2, 2, "OK"),
        ("r", 2, 2, "OK"),
    ]
    marked = quality.sentinel_fields(df, ["n", "g"]).select("missing_fields")
    assert [r[0] for r in marked.collect()] == [["g"], []]


def test_dims(spark):
    df = spark.createDataFrame([([1.0, 2.0],), ([1.0],), (None,)], "v array<float>")
    assert tuple(quality.check_dims(df, "v", 2).first()) == (3, 2, 1, 2, 1, 1)


def test_vocabulary(spark):
    df = spark.createDataFrame([("rose, musk", "a"), ("musk,,", None)], "x string, y string")
    assert rows(quality.vocabulary(df, ["x", "y"])) == [("x", "musk"), ("x", "rose"), ("y", "a")]


# -- stored tables -----------------------------------------------------------


def test_publish_versions(spark):
    root = runtime.scratch_path(spark, "t")
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("a", T.StringType())])
    assert store.read_current(spark, root, schema).count() == 0
    assert store.publish(spark.createDataFrame([(1, "x")], schema), root) == 1
    before = store.read_current(spark, root)
    # A new state is written while the old one is being read.
    assert store.publish(before.drop("a").withColumn("b", F.lit(1)), root) == 1
    assert rows(store.read_current(spark, root).select("id", "a", "b")) == [(1, None, 1)]
    assert store.append(spark.createDataFrame([(2,)], "id long"), root) == 1
    assert store.append(spark.createDataFrame([], "id long"), root) == 0
    with pytest.raises(ValueError, match="zz"):
        store.append(spark.createDataFrame([(1, 2)], "id long, zz long"), root)
    assert rows(store.read_current(spark, root).select("id", "a", "b")) == [(1, None, 1), (2, None, None)]
    assert rows(before) == [(1, "x")]


def test_failed_publish_leaves_the_table(spark):
    root = runtime.scratch_path(spark, "t")
    store.publish(spark.range(3), root)
    broken = spark.range(3).select(F.raise_error(F.lit("no")).cast("bigint").alias("id"))
    with pytest.raises(Exception, match="no"):
        store.publish(broken, root)
    assert store.read_current(spark, root).count() == 3
    assert store.publish(spark.range(5), root) == 5
    assert store.read_current(spark, root).count() == 5


def test_csv_keeps_quotes_and_line_breaks(spark):
    path = runtime.scratch_path(spark, "csv")
    value = 'He said "no",\nthen \\ left; \'x\' -- y'
    df = spark.createDataFrame([("u", value), ("v", None)], "url string, name string")
    store.write_csv(df, path)
    schema = T.StructType([T.StructField("url", T.StringType()), T.StructField("name", T.StringType())])
    assert rows(store.read_raw_csv(spark, path, schema, multi_line=True)) == [("u", value), ("v", None)]


def test_clustered_write_splits_a_hot_key(spark):
    path = runtime.scratch_path(spark, "c")
    df = spark.range(20_000).select(F.lit(1).alias("k"), "id")
    store.write_clustered(df, path, ["k"], files=4)
    sizes = store.read_table(spark, path).groupBy(F.input_file_name()).count().collect()
    assert len(sizes) == 4 and sum(r["count"] for r in sizes) == 20_000


def test_observed_rows(spark):
    counted, seen = quality.observe_rows(spark.range(7), "n")
    counted.write.format("noop").mode("overwrite").save()
    assert seen.get == {"rows": 7}


def test_read_prunes_columns_and_pushes_the_key(spark, tmp_path):
    spark.range(10).select("id", F.lit(1).alias("a"), F.lit(2).alias("b")).write.parquet(str(tmp_path / "t"))
    df = store.read_table(spark, str(tmp_path / "t"), ["id", "a"]).filter(F.col("id") == 3)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(id,3)" in plan and "ReadSchema: struct<id:bigint,a:int>" in plan


def test_append_without_job_markers_keeps_the_table(spark, tmp_path):
    conf, name = spark._jsc.hadoopConfiguration(), "mapreduce.fileoutputcommitter.marksuccessfuljobs"
    root = str(tmp_path / "unmarked")
    conf.set(name, "false")
    try:
        store.publish(spark.range(3), root)
        store.append(spark.range(3, 5), root)
        assert store.read_current(spark, root).count() == 5
        store.publish(spark.range(1), root)
        assert store.read_current(spark, root).count() == 1
    finally:
        conf.unset(name)


def test_unfinished_versions_are_not_replaced(spark, tmp_path):
    root = str(tmp_path / "begun")
    spark.range(4).write.parquet(f"{root}/version=1")
    (tmp_path / "begun" / "version=1" / "_SUCCESS").unlink()
    with pytest.raises(RuntimeError):
        store.append(spark.range(2), root)
    store.publish(spark.range(2), root)
    assert spark.read.parquet(f"{root}/version=1").count() == 4 and store.read_current(spark, root).count() == 2


def test_csv_keeps_outer_white_space(spark, tmp_path):
    rows = [("  lead and trail  ",), ("\ttab",), ('q"uote ',), ("a\r\nb ",)]
    path = str(tmp_path / "csv")
    df = spark.createDataFrame(rows, "text string")
    store.write_csv(df, path)
    assert sorted(r.text for r in store.read_raw_csv(spark, path, df.schema, multi_line=True).collect()) == sorted(r[0] for r in rows)


# -- tables partitioned by a hash of the key ---------------------------------


def stored_files(spark, root):
    from catalog_engine.sources import partitions

    return {
        p: sorted((f.name, f.stat().st_mtime_ns) for f in Path(path.removeprefix("file:")).iterdir())
        for (_, p), path in partitions.folders(spark, root).items()
    }


def test_only_partitions_that_a_change_meets_are_rewritten(spark, tmp_path):
    from catalog_engine.sources import partitions as P

    root, df = str(tmp_path / "t"), spark.createDataFrame([(i, f"v{i}") for i in range(200)] + [(None, "n")], "k long, v string")
    assert P.read(spark, root, df.schema, 8).count() == 0
    assert P.overwrite(df, root, "k", 8) == 201
    assert rows(P.read(spark, root, df.schema, 8)) == rows(df)
    first = stored_files(spark, root)
    assert len(first) == 8

    keys = spark.createDataFrame([(5,)], "k long")
    met = P.met_by(keys, "k", 8)
    state = P.read(spark, root, df.schema, 8, met)
    assert len(met) == 1 and 0 < state.count() < 201
    plan = state._jdf.queryExecution().executedPlan().toString()
    assert f"PartitionFilters: [isnotnull(key_hash_8" in plan and f"= {met[0]})" in plan
    # The state that is replaced is read while it is replaced.
    size = state.count()
    assert P.overwrite(state.filter("k <> 5 or k is null"), root, "k", 8, met) == size - 1
    assert rows(P.read(spark, root, df.schema, 8)) == rows(df.filter("k is null or k <> 5"))
    second = stored_files(spark, root)
    assert {p for p in first if first[p] != second[p]} == set(met)

    # A partition that loses all rows is gone; rows may be added to it again.
    P.overwrite(state.limit(0), root, "k", 8, met)
    assert P.read(spark, root, df.schema, 8).count() == 201 - size and set(stored_files(spark, root)) == set(first) - set(met)
    assert P.append(spark.createDataFrame([(5,), (6,)], "k int"), root, "k", 8) == 2
    assert P.read(spark, root, df.schema, 8).filter("v is null").count() == 2
    with pytest.raises(ValueError, match="8 partitions"):
        P.overwrite(df, root, "k", 4)
    with pytest.raises(ValueError, match="no column"):
        P.append(df.withColumn("more", F.lit(1)), root, "k", 8)
    with pytest.raises(ValueError, match="key_hash_8"):
        P.overwrite(df.withColumn("key_hash_8", F.lit(1)), root, "k", 8)


def test_partitions_of_other_columns_keep_theirs(spark, tmp_path):
    from catalog_engine.sources import partitions as P

    root = str(tmp_path / "t")
    df = spark.createDataFrame([(i, f"v{i}", "b") for i in range(40)], "k long, v string, b string")
    P.overwrite(df, root, "k", 4)
    narrow = df.drop("b").withColumn("v", F.lit("new"))
    for met in ([0, 1], [2]):
        # A column is missing, and another is new.
        part = narrow.filter(P.partition_of(narrow, "k", 4).isin(met)).withColumn("c", F.lit(len(met)))
        P.overwrite(part, root, "k", 4, met)
    got = P.read(spark, root, df.schema, 4)
    assert set(got.columns) == {"k", "v", "b", "c"}
    kept = P.partition_of(got, "k", 4) == 3
    assert got.filter(kept).filter("b <> 'b' or c is not null").isEmpty()
    assert got.filter(~kept).filter("b is not null or v <> 'new' or c is null").isEmpty()
    assert got.count() == 40


def test_a_failed_change_of_partitions_leaves_the_table(spark, tmp_path):
    from catalog_engine.sources import partitions as P

    root, df = str(tmp_path / "t"), spark.createDataFrame([(i, "v") for i in range(50)], "k long, v string")
    P.overwrite(df, root, "k", 4)
    before = stored_files(spark, root)
    broken = df.withColumn("v", F.when(F.col("k") == 7, F.raise_error(F.lit("no"))).otherwise("w"))
    with pytest.raises(Exception, match="no"):
        P.overwrite(broken, root, "k", 4)
    assert rows(P.read(spark, root, df.schema, 4)) == rows(df) and stored_files(spark, root) == before
    assert P.overwrite(df.limit(3), root, "k", 4) == 3
    assert P.read(spark, root, df.schema, 4).count() == 3


def test_upsert_shuffles_a_large_table_twice(spark, tmp_path):
    """Its rows once, and once more its keys."""
    spark.range(1000).selectExpr("id", "cast(id as string) a", "'b' b").write.parquet(f"{tmp_path}/t")
    spark.range(500, 1500).selectExpr("id", "'n' a").write.parquet(f"{tmp_path}/s")
    target, source = (spark.read.parquet(f"{tmp_path}/{x}") for x in "ts")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        df = upsert(target, source, "id", ["a"])
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") <= 7 and plan.count("SortMergeJoin") == 2
        assert df.count() == 1500 and df.filter("a = 'n'").count() == 1000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
