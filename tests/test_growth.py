"""What a task has to hold, write down or repeat as tables grow."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from catalog_engine import rules
from catalog_engine import schema as schemas
from catalog_engine.functions import text
from catalog_engine.operators import html_fields
from catalog_engine.operators.dedupe import Leads, dedupe_best, unbeaten
from catalog_engine.operators.html_fields import pieces
from catalog_engine.operators.upsert import ambiguous_keys
from catalog_engine.plans import ingest
from catalog_engine.plans.clean import clean_items


def test_most_copies_are_dropped_before_any_sort(spark):
    rows = [(k, random.Random(7 * k + c).randrange(10_000), "x" * 50) for c in range(200) for k in range(20)]
    df = spark.createDataFrame(rows, "k int, n int, wide string").coalesce(1)
    left = unbeaten(df, ["k"], text.int_lead("n"))
    assert left.count() < len(rows) / 10
    best = {k: max(n for j, n, _ in rows if j == k) for k in range(20)}
    assert {(r.k, r.n) for r in left.groupBy("k").agg(F.max("n").alias("n")).collect()} == set(best.items())


def test_a_lead_changes_no_result(spark):
    rng = random.Random(3)
    values = [None, -5, 0, 7, 7, 2**31 - 1, -(2**31)]
    keys = [None, "a", "b", ""]
    rows = [(rng.choice(keys), rng.choice(keys), rng.choice(values), i) for i in range(2000)]
    df = spark.createDataFrame(rows, "a string, b string, n int, i int").repartition(3)
    order = [F.desc_nulls_last("n"), F.asc("i")]
    plain = dedupe_best(df, ["a", "b"], order).collect()
    assert sorted(map(str, dedupe_best(df, ["a", "b"], order, text.int_lead("n")).collect())) == sorted(map(str, plain))


def test_text_leads_are_in_the_order_of_texts(spark):
    texts = [None, "", "1", "12", "12,037", "9", "N/A", "abcdefgh", "abcdefgz", "\u00e9", "\U0001f600", "\x00"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("lead", text.text_lead("t"))
    leads = [r.lead for r in df.orderBy(F.asc_nulls_first("t")).collect()]
    assert leads == sorted(leads) and leads[0] == -1 and len(set(leads)) >= len(texts) - 2


def test_leads_of_more_keys_than_places():
    rng = np.random.default_rng(1)
    key, lead = rng.integers(0, 50, 5000), rng.integers(0, 1000, 5000)
    kept, seen = np.zeros(5000, bool), Leads(size=8)
    for start in range(0, 5000, 100):
        some = slice(start, start + 100)
        kept[some] = seen.unbeaten(key[some], key[some] + 1, lead[some])
    assert all(kept[lead == lead[key == k].max()][key[lead == lead[key == k].max()] == k].all() for k in range(50))


def test_the_clean_job_sorts_unbeaten_copies_only(spark):
    rows = [(f"https://h/perfume/B/N-{i % 5}.html", str(i)) for i in range(2000, 0, -1)]
    raw = spark.createDataFrame(rows, "url string, rating_count string")
    for c in ("name", "gender", "rating", "main_accords", "perfumers", "description"):
        raw = raw.withColumn(c, F.lit("v"))
    for order_as in ("number", "string"):
        out = clean_items(raw, order_as)
        assert "ArrowEvalPython" in out._jdf.queryExecution().executedPlan().toString()
        best = {}
        for url, n in rows:
            best[url] = max(best.get(url, "0"), n, key=int if order_as == "number" else str)
        assert {r.url: str(r.rating_count) for r in out.collect()} == best


def test_upsert_keys_stay_in_many_tasks(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        source = spark.range(100_000).withColumnRenamed("id", "k").groupBy("k").agg(F.count(F.lit(1)).alias("n"))
        plan = ambiguous_keys(source, "k")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # An exchange that Spark put there itself would be coalesced by the few bytes its keys have.
    assert "REPARTITION_BY_NUM" in plan


def test_page_fields_are_held_by_pieces():
    pages = ["x" * 10, None, "y" * 95, "z" * 300, "", "u" * 5]
    batch = pa.record_batch({"n": list(range(6)), "html": pages})
    found = [p.column("n").to_pylist() for p in pieces(batch, "html", 100)]
    assert found == [[0, 1], [2], [3], [4, 5]]
    assert list(pieces(batch.slice(0, 0), "html")) == []


def test_few_large_pages_are_not_held_together(spark):
    page = "<html><head><title>t</title></head><body><p>" + "w " * 300_000 + "</p></body></html>"
    run = []

    class Frame:
        """Takes the function that would run on the workers."""

        def mapInArrow(self, function, schema):
            run.append(function)

    df = spark.createDataFrame([(1, page)], "page_id int, html string")
    spread = html_fields.runtime.spread
    html_fields.runtime.spread = lambda _: Frame()
    try:
        html_fields.extract_html_fields(df, "html", [html_fields.HtmlRule("title", (html_fields.Find("title"),))])
    finally:
        html_fields.runtime.spread = spread
    batch = pa.record_batch({"page_id": [1, 2, 3, 4], "html": [page] * 4})
    out = list(run[0](iter([batch])))
    assert [b.num_rows for b in out] == [1, 1, 1, 1]
    assert [t for b in out for t in b.column("title").to_pylist()] == ["t"] * 4


def test_fields_of_a_batch_are_extracted_once(spark):
    records = spark.createDataFrame(
        [(f"https://h/perfume/B/N-{i}.html", "['a']", "d") for i in range(4)], "url string, main_accords string, description string"
    )
    layers = ingest.Layers(*(spark.createDataFrame([], s) for s in (schemas.RAW, schemas.CLEAN, schemas.EMBEDDINGS)))
    cleaned, real = [], ingest.runtime.written
    ingest.runtime.written = lambda df: cleaned.append(df._jdf.queryExecution().optimizedPlan().toString()) or real(df)
    try:
        batch = ingest.prepare(records, layers)
    finally:
        ingest.runtime.written = real
    assert batch.report.count() == 4
    # The status is made of fields that are written down: only records without an address are read for it again.
    assert cleaned[-1].count(rules.LAUNCH_YEAR_PATTERN) == 1
