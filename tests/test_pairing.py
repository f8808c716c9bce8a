"""Requests meet a large table on the executors."""

import pyarrow as pa
import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog_engine.operators import pairing, similar
from catalog_engine.operators.search import search_terms


class Sums:
    """For every request the sum of all items it is a divisor of."""

    def __init__(self, requests: pa.Table):
        self.asked = requests.column("d").to_pylist()
        self.sums = [0] * len(self.asked)

    def add(self, block: pa.Table) -> None:
        for i, d in enumerate(self.asked):
            self.sums[i] += sum(x for x in block.column("x").to_pylist() if x % d == 0)

    def result(self) -> pa.Table:
        return pa.table({"d": pa.array(self.asked, pa.int64()), "s": pa.array(self.sums, pa.int64())})


def sums(items, requests, max_bytes):
    found = pairing.score_blocks(items, requests, Sums, "d long, s long", F.lit(8), max_bytes)
    return {r.d: r.s for r in found.groupBy("d").agg(F.sum("s").alias("s")).collect()}


@pytest.mark.parametrize("max_bytes", [1 << 20, 800, 80, 8])
def test_every_request_meets_every_item_once(spark, max_bytes):
    items = spark.range(1, 2001, 1, 7).withColumnRenamed("id", "x").withColumn("pad", F.lit("p"))
    requests = spark.range(1, 61, 1, 3).withColumnRenamed("id", "d")
    want = {d: sum(x for x in range(1, 2001) if x % d == 0) for d in range(1, 61)}
    assert sums(items, requests, max_bytes) == want
    assert sums(items.filter("x < 0"), requests, max_bytes).keys() <= want.keys()
    assert sums(items, requests.filter("d < 0"), max_bytes) == {}


def shuffled(df: DataFrame) -> list[str]:
    """The exchanges of a plan that deal rows by what they hold."""
    plan = df._jdf.queryExecution().executedPlan().toString().splitlines()
    return [line for line in plan if "Exchange" in line and "partitioning(" in line]


def test_few_requests_move_no_item_and_nothing_passes_the_driver(spark, monkeypatch, tmp_path):
    vectors = spark.range(500).select("id", F.array(F.rand(1), F.rand(2)).alias("embedding"))
    vectors.repartition(4).write.parquet(str(tmp_path / "v"))
    names = spark.range(500).select("id", F.concat(F.lit("name "), "id").alias("name"))
    names.repartition(4).write.parquet(str(tmp_path / "n"))
    vectors, names = spark.read.parquet(str(tmp_path / "v")), spark.read.parquet(str(tmp_path / "n"))
    collect = type(vectors).collect

    def one_row_of_numbers(df):
        rows = collect(df)
        assert len(rows) <= 1 and all(isinstance(x, int) for r in rows for x in r)
        return rows

    for way in ("toArrow", "toPandas", "toLocalIterator"):
        monkeypatch.setattr(type(vectors), way, None)
    monkeypatch.setattr(type(vectors), "collect", one_row_of_numbers)
    kernel = lambda block: similar._Nearest(block, "id", 3)
    asked = vectors.filter("id < 20").select(F.col("id").alias("target"), F.col("embedding").alias("_vec"))
    items = vectors.select("id", F.col("embedding").alias("_vec"))
    found = pairing.score_blocks(items, asked, kernel, "target long, id long, similarity double", F.lit(100))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and plan.count("Scan parquet") == 1
    # All that moves is the block of requests, on its way to the broadcast.
    assert not shuffled(found) and plan.count("Exchange SinglePartition") == 1
    for top in (
        similar.top_n_batch(vectors, vectors.filter("id < 20"), "id", "embedding", 3),
        search_terms(names, names.limit(5).select(F.col("name").alias("term"))),
    ):
        # Only the lists that were found meet by request.
        assert all("target" in line or "term" in line for line in shuffled(top))
        assert not any("embedding" in line or "_vec" in line or "_norm" in line for line in shuffled(top))
        assert top.count() > 0


def test_many_blocks_are_one_job_on_the_executors(spark, monkeypatch):
    items = spark.range(1, 301, 1, 4).withColumnRenamed("id", "x")
    requests = spark.range(1, 41, 1, 3).withColumnRenamed("id", "d")
    monkeypatch.setattr(type(items), "toArrow", None)
    found = pairing.score_blocks(items, requests, Sums, "d long, s long", F.lit(8), 16)
    assert len([line for line in shuffled(found) if "__group" in line]) == 1
    assert found.select("d").distinct().count() == 40
