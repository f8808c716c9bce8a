import numpy as np
import pytest
from pyspark.sql import functions as F

from catalog_engine.functions import vectors
from catalog_engine.operators import similar
from catalog_engine.plans.recommend import recommend, recommend_batch

SCHEMA = "id string, embedding array<float>"
FOUR = [("a", [1.0, 0.0]), ("b", [2.0, 0.0]), ("c", [0.0, 1.0]), ("d", [-1.0, 0.0])]


@pytest.fixture
def four(spark):
    return spark.createDataFrame(FOUR, SCHEMA)


def pairs(df):
    return [(r.id, r.similarity) for r in df.collect()]


def test_order_and_self_exclusion(four):
    assert pairs(similar.top_n_similar(four, "id", "embedding", "a", 3)) == [("b", 1.0), ("c", 0.0), ("d", -1.0)]


def test_n_is_clamped(four):
    assert len(pairs(similar.top_n_similar(four, "id", "embedding", "a", 99))) == 3
    assert pairs(similar.top_n_similar(four, "id", "embedding", "a", 1)) == [("b", 1.0)]


def test_missing_target(four):
    with pytest.raises(ValueError, match="'zz'"):
        similar.top_n_similar(four, "id", "embedding", "zz", 3)


def test_long_ids(spark):
    df = spark.createDataFrame([(i, v) for i, (_, v) in enumerate(FOUR)], "id long, embedding array<float>")
    assert pairs(similar.top_n_similar(df, "id", "embedding", 0, 1)) == [(1, 1.0)]


def test_bad_vectors(spark):  # D13
    rows = FOUR + [("zero", [0.0, 0.0]), ("none", None), ("long", [1.0, 0.0, 0.0]), ("hole", [1.0, None])]
    df = spark.createDataFrame(rows, SCHEMA)
    got = pairs(similar.top_n_similar(df, "id", "embedding", "a", 9))
    assert got == [("b", 1.0), ("c", 0.0), ("d", -1.0), ("hole", None), ("long", None), ("zero", None)]


def test_copies_of_the_target_take_no_slot(spark):  # D12
    df = spark.createDataFrame([("a", [1.0, 0.0])] * 3 + FOUR[1:], SCHEMA)
    assert [i for i, _ in pairs(similar.top_n_similar(df, "id", "embedding", "a", 2))] == ["b", "c"]


def test_norm_dot_cosine(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0], [0.0, 0.0])], "a array<float>, b array<float>, z array<float>")
    got = df.select(vectors.norm("a"), vectors.dot("a", "b"), vectors.cosine("a", "b"), vectors.cosine("a", "z")).first()
    assert tuple(got)[:3] == (5.0, 24.0, pytest.approx(0.96)) and got[3] is None


def brute(ids, m, targets, n):
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    sims = np.round(unit @ unit.T, similar.DECIMALS)
    out = {}
    for t in targets:
        order = sorted((i for i in ids if i != t), key=lambda i: (-sims[t, i], i))[:n]
        out[t] = [(i, float(sims[t, i])) for i in order]
    return out


@pytest.mark.parametrize("max_bytes", [1 << 24, 4000, 900])
def test_batch_equals_brute_force(spark, max_bytes):
    rng = np.random.default_rng(1)
    m = rng.standard_normal((200, 8)).astype(np.float32)
    m[100:150] = m[0]  # a quarter of the items are copies of one vector
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "id long, embedding array<float>").repartition(5)
    targets = df.filter(F.col("id") < 20)
    got = similar.top_n_batch(df, targets, "id", "embedding", 4, max_bytes=max_bytes)
    found = {}
    for r in got.orderBy("target", "rank").collect():
        found.setdefault(r.target, []).append((r.id, r.similarity))
    want = brute(range(200), m.astype(np.float64), range(20), 4)
    assert {t: [i for i, _ in v] for t, v in found.items()} == {t: [i for i, _ in v] for t, v in want.items()}
    for t in want:
        assert np.allclose([s for _, s in found[t]], [s for _, s in want[t]])


def test_batch_without_targets(four):
    assert similar.top_n_batch(four, four.filter(F.lit(False)), "id", "embedding", 3).count() == 0


def test_missing_targets(spark, four):
    wanted = spark.createDataFrame([("a",), ("zz",)], "id string")
    assert [r.id for r in similar.missing_targets(wanted, four, "id", "embedding").collect()] == ["zz"]


def test_small_requests_do_not_shuffle_items(four):
    plan = similar.top_n_similar(four, "id", "embedding", "a", 2)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "TakeOrderedAndProject" in plan


def test_recommend_inner_and_left(spark, four):  # D11
    items = spark.createDataFrame([("b", "B"), ("d", "D"), ("x", "X")], "id string, name string")
    assert [(r.id, r["name"]) for r in recommend(items, four, "a", 3).collect()] == [("b", "B"), ("d", "D")]
    left = recommend(items, four, "a", 3, how="left").collect()
    assert [(r.id, r["name"]) for r in left] == [("b", "B"), ("c", None), ("d", "D")]


def test_recommend_pushes_the_found_keys(spark, four, tmp_path):
    spark.createDataFrame([("b", "B"), ("d", "D")], "id string, name string").write.parquet(str(tmp_path / "items"))
    got = recommend(spark.read.parquet(str(tmp_path / "items")), four, "a", 3)
    assert "In(id, [b,c,d])" in got._jdf.queryExecution().executedPlan().toString().replace("IN", "In")
    assert [r.id for r in got.collect()] == ["b", "d"]
    long_list = recommend(spark.read.parquet(str(tmp_path / "items")), four, "a", 1000)
    assert [r.id for r in long_list.collect()] == ["b", "d"]


def test_recommend_batch(spark, four):
    items = spark.createDataFrame([("a", "A"), ("b", "B"), ("c", "C"), ("d", "D")], "id string, name string")
    targets = spark.createDataFrame([("a",), ("c",), ("zz",)], "id string")
    got = recommend_batch(items, four, targets, 1).collect()
    assert sorted((r.target, r.id, r["name"]) for r in got) == [("a", "b", "B"), ("c", "a", "A")]


def test_sizes_and_copies_do_not_depend_on_blocks(spark):
    items = spark.createDataFrame(
        [(1, [1.0, 0.0]), (2, [2.0, 1.0]), (3, [0.0, 1.0, 0.0]), (4, [0.0, 2.0, 1.0]), (5, [1.0, 1.0])],
        "id long, v array<double>",
    )
    targets = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (3, [0.0, 1.0, 0.0]), (4, [0.0, 2.0, 1.0])], "id long, v array<double>")

    def answers(**options):
        found = similar.top_n_batch(items, targets, "id", "v", 2, **options)
        return sorted((r.target, r["rank"], r.id, r.similarity) for r in found.collect())

    small = answers()
    assert small == answers(max_bytes=1)
    assert [(t, i) for t, _, i, _ in small if t == 1] == [(1, 2), (1, 5)]
    assert [i for t, r, i, _ in small if r == 1] == [2, 4, 3]


@pytest.mark.parametrize("n", [2, 200])
def test_text_ids_among_items_meet_number_ids_of_embeddings(spark, n):
    items = spark.createDataFrame([("1", "one"), ("2", "two"), ("ab3", "none"), ("004", "four")], "id string, name string")
    stored = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.5]), (4, [0.0, 1.0]), (7, [0.0, -1.0])], "id long, embedding array<float>")
    assert [r.name for r in recommend(items, stored, "1", n).collect()] == ["two", "four"]
    left = [(r.id, r.name) for r in recommend(items, stored, 1, 3, how="left").collect()]
    assert (2, "two") in left and (7, None) in left
    many = recommend_batch(items, stored, spark.createDataFrame([("1",), ("ab3",)], "id string"), n)
    assert {(r.target, r.name) for r in many.collect()} == {(1, "two"), (1, "four")}
    with pytest.raises(ValueError):
        recommend(items, stored, "ab3", n)
