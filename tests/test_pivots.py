"""Top-N by pivots against the top-N that looks at everything."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from catalog_engine.operators import pivots, similar


def answers(df):
    return sorted((r.target, r["rank"], r.id, r.similarity) for r in df.collect())


def clustered(spark, n=4000, dims=16, centres=40, seed=3):
    rng = np.random.default_rng(seed)
    middle = rng.standard_normal((centres, dims))
    rows = middle[rng.integers(0, centres, n)] + 0.08 * rng.standard_normal((n, dims))
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows.astype(np.float32))], "id long, v array<float>").repartition(4)


@pytest.mark.parametrize("n", [1, 7])
def test_pivots_equal_brute_force_on_clusters(spark, n):
    items = clustered(spark)
    targets = items.filter("id % 40 = 0")
    want = answers(similar.top_n_batch(items, targets, "id", "v", n))
    assert answers(pivots.top_n_pivots(items, targets, "id", "v", n, pivots=48)) == want and len(want) == 100 * n


def test_pivots_equal_brute_force_without_structure(spark):
    rng = np.random.default_rng(5)
    items = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.standard_normal((500, 6)))], "id long, v array<double>")
    targets = items.filter("id < 30")
    assert answers(pivots.top_n_pivots(items, targets, "id", "v", 4, pivots=16)) == answers(similar.top_n_batch(items, targets, "id", "v", 4))


ODD = [
    (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [2.0, 0.0]), (4, [0.0, 0.0]), (5, None), (6, [0.0, 1.0, 0.0]), (7, [0.0, 2.0, 1.0]),
    (8, []), (9, [-1.0, 0.0]), (10, [0.0, 1.0]), (1, [1.0, 0.5]), (11, [1e-30, 1e-30]), (None, [1.0, 1.0]),
]


@pytest.mark.parametrize("pivot_count", [1, 3, 64])
def test_odd_vectors_get_the_same_answers(spark, pivot_count):
    items = spark.createDataFrame(ODD, "id long, v array<double>")
    targets = items.filter("id is not null").unionByName(spark.createDataFrame([(99, [0.5, 0.5]), (98, [0.0] * 5)], "id long, v array<double>"))
    for n in (1, 3, 20):
        want = answers(similar.top_n_batch(items, targets, "id", "v", n))
        assert answers(pivots.top_n_pivots(items, targets, "id", "v", n, pivots=pivot_count)) == want
    nothing = items.filter("id = -5")
    assert answers(pivots.top_n_pivots(nothing, targets, "id", "v", 2)) == []
    assert answers(pivots.top_n_pivots(items, nothing, "id", "v", 2)) == []


def test_many_copies_and_split_rings(spark, monkeypatch):
    monkeypatch.setattr(pivots, "PART", 50)
    monkeypatch.setattr(pivots, "ASKING", 8)
    items = clustered(spark, 800, 4, 5).unionByName(spark.range(10_000, 10_400).select("id", F.array(*[F.lit(x).cast("float") for x in (1, 2, 3, 4)]).alias("v")))
    targets = items.filter("id % 20 = 0")
    want = answers(similar.top_n_batch(items, targets, "id", "v", 6))
    assert answers(pivots.top_n_pivots(items, targets, "id", "v", 6, pivots=20)) == want


def test_most_pairs_of_clustered_vectors_are_left_out(spark):
    items = clustered(spark)
    share = pivots.skipped_share(items, items.filter("id % 40 = 0"), "id", "v", 5, pivots=48)
    print(f"skipped: {share:.3f}")
    assert 0.8 < share < 1
