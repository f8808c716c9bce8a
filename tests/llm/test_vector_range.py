"""Vectors whose squares are out of range of double precision, and extra columns."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from catalog_engine.llm import itq, multi_index


def test_large_and_small_vectors_link(spark):
    rows = [
        (1, [1e200, 1e200]), (2, [2e200, 2e200]), (3, [1e-200, 1e-200]), (4, [1.0, 1.0]), (5, [-1e200, 1e200]),
        (6, [1e308, 1e308]), (7, [5e-324, 5e-324]), (8, [0.0, 0.0]), (9, [1.0, -1.0]),
    ]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, rep int, codes int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in itq.near_vectors(df).collect()}
    assert {got[i] for i in (1, 2, 3, 4, 6, 7)} == {(5, 1)}
    assert got[5] == (0, 5) and got[8] == (0, 8) and got[9] == (0, 9)


def test_large_and_small_distances_rank(spark):
    rows = [(0, [1e200, 0.0]), (100, [0.0, 1e-200])] + [(i, [i * 1e199, 0.0]) for i in range(1, 9)]
    rows += [(50 + i, [0.0, i * 1e-201]) for i in range(1, 6)] + [(90, [3.0, 4.0])]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, score int, rank int")
    found = multi_index.nearest(df, df.filter(F.col("vec_id") % 100 == 0), top=4).orderBy("query_id", "rank").collect()
    far = {r: math.hypot(*np.subtract(v, rows[0][1])) for r, v in rows}
    want = sorted((d, i) for i, d in far.items() if i)[:4]
    got = [(r.score, r.vec_id) for r in found if r.query_id == 0]
    assert [i for _, i in got] == [i for _, i in want]
    assert [d for d, _ in got] == pytest.approx([d for d, _ in want], rel=1e-12)
    near = [(r.vec_id, r.score) for r in found if r.query_id == 100]
    assert [i for i, _ in near] == [55, 54, 53, 52] and near[0][1] == pytest.approx(5e-201)


def test_gaps_equal_plain_distances():
    rng = np.random.default_rng(3)
    block, query = rng.standard_normal((50, 7)), rng.standard_normal(7)
    assert (multi_index.gaps(block, query) == np.sqrt(((block - query) ** 2).sum(axis=1))).all()
    for scale in (1e-200, 1e200, 5e-324):
        want = [math.hypot(*(b - query * scale)) for b in block * scale]
        assert multi_index.gaps(block * scale, query * scale) == pytest.approx(want, rel=1e-12)
    assert multi_index.gaps(np.array([[1.0]]), np.array([1.0])) == [0.0]
