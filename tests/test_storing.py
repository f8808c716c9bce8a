"""Catalog tables, files that lookups skip, pages as bytes, older pages, arriving files."""

import re
import uuid

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalog_engine import schema
from catalog_engine.operators.encode import HashingEncoder
from catalog_engine.operators.html_fields import legacy_pages_to_raw
from catalog_engine.operators.keys import is_bucketed, listed, unlisted
from catalog_engine.operators.upsert import upsert
from catalog_engine.plans import arriving, ingest, jobs
from catalog_engine.sources import pages
from catalog_engine.sources import tables as store


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture
def name(spark):
    made = f"t_{uuid.uuid4().hex}"
    yield made
    spark.sql(f"DROP TABLE IF EXISTS {made}")


# -- catalog tables ---------------------------------------------------------------


def test_a_table_by_name(spark, tmp_path, name):
    df = spark.range(100).select("id", F.col("id").cast("string").alias("v"))
    store.save_table(df, name, "id", buckets=8, path=str(tmp_path / "a"))
    assert rows(store.read_table(spark, name)) == rows(df)
    with pytest.raises(Exception, match="already exists"):
        store.save_table(df, name)
    store.append_table(spark.createDataFrame([(500,)], "id int"), name)
    assert spark.table(name).filter("id = 500 and v is null").count() == 1
    with pytest.raises(ValueError, match="no column"):
        store.append_table(df.withColumn("w", F.lit(1)), name)
    # A new state made of the present one; a column it lacks stays.
    store.replace_table(spark.table(name).filter("id < 5").select("id"), name, "id", 8, str(tmp_path / "b"))
    assert rows(spark.table(name)) == [(i, None) for i in range(5)]
    assert is_bucketed(spark.table(name), "id") and not is_bucketed(spark.table(name), "v")
    assert not is_bucketed(spark.table(name).select((F.col("id") + 1).alias("id")), "id") and not is_bucketed(df, "id")


def moved(df):
    """What lies below each exchange of a plan, broadcasts left out."""
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    depth = [len(re.match(r"[\s:|+\-]*", line)[0]) for line in lines]
    found = []
    for i, line in enumerate(lines):
        if "Exchange" in line and "Broadcast" not in line:
            end = next((j for j in range(i + 1, len(lines)) if depth[j] <= depth[i]), len(lines))
            found.append("\n".join(lines[i:end]))
    return found


def test_a_bucketed_table_is_not_shuffled(spark, tmp_path, name):
    df = spark.range(2000).select("id", F.col("id").cast("string").alias("a"), F.lit("b").alias("b"))
    store.save_table(df, name, "id", buckets=16, path=str(tmp_path / "t"))
    spark.range(1500, 2500).select("id", F.lit("n").alias("a"), F.lit("m").alias("b")).write.parquet(str(tmp_path / "s"))
    source, limit = spark.read.parquet(str(tmp_path / "s")), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    stored = spark.table(name)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        cases = {
            "J1": (unlisted(source, stored, "id"), 500),
            "J2": (unlisted(stored, source, "id"), 1500),
            "F4": (listed(stored, source, "id"), 500),
            "M1": (upsert(stored, source, "id"), 2500),
            "M2": (upsert(stored, source, "id", ["a"]), 2500),
        }
        for case, (got, count) in cases.items():
            below = moved(got)
            assert below and not any(name in part for part in below), case
            assert got.count() == count, case
        assert rows(cases["M2"][0]) == rows(upsert(df, source, "id", ["a"]))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


# -- files that lookups skip --------------------------------------------------------


def rows_scanned(df):
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.executedPlan() if "Adaptive" in plan.getClass().getSimpleName() else plan
    leaves = plan.collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))


def test_lookups_read_few_row_groups(spark, tmp_path):
    df = spark.range(200_000).select(F.xxhash64("id").alias("k"), F.md5(F.col("id").cast("string")).alias("t")).repartition(4)
    store.write_lookup(df, str(tmp_path / "t"), ["k", "t"], distinct=20_000, row_group_bytes=256 * 1024)
    plain = str(tmp_path / "p")
    df.write.option("parquet.block.size", str(256 * 1024)).parquet(plain)
    # From the middle of the keys, where every row group's range holds it.
    wanted = df.filter(F.abs("k") < 2**50).orderBy("k").first()
    for key in ("k", "t"):
        found = spark.read.parquet(str(tmp_path / "t")).filter(F.col(key) == F.lit(wanted[key]))
        assert found.count() == 1
        assert rows_scanned(found) < 0.2 * rows_scanned(spark.read.parquet(plain).filter(F.col(key) == F.lit(wanted[key])))
    # The footers name the filters.
    reader = spark._jvm.org.apache.parquet.hadoop.ParquetFileReader
    conf, hadoop = spark._jsc.hadoopConfiguration(), spark._jvm.org.apache.hadoop.fs.Path
    for f in (tmp_path / "t").glob("*.parquet"):
        blocks = reader.readFooter(conf, hadoop(str(f))).getBlocks()
        assert blocks.size() > 1
        assert all(c.getBloomFilterOffset() > 0 for b in blocks for c in b.getColumns())


def files_met(path, column, low, high):
    met = 0
    for f in path.glob("*.parquet"):
        meta = pq.read_metadata(f)
        at = meta.schema.names.index(column)
        stats = [meta.row_group(g).column(at).statistics for g in range(meta.num_row_groups)]
        met += any(s.min <= high and s.max >= low for s in stats)
    return met


def test_zorder_skips_files_by_either_key(spark, tmp_path):
    df = spark.range(40_000).select(
        (F.xxhash64("id") % 1000).alias("a"), F.rand(7).alias("b"), F.concat(F.lit("k"), F.pmod(F.hash("id"), F.lit(500))).alias("c")
    )
    df = df.unionByName(spark.range(50).select(F.lit(None).cast("long").alias("a"), F.lit(0.5).alias("b"), F.lit(None).cast("string").alias("c")))
    store.write_zordered(df, str(tmp_path / "z"), ["a", "b"], files=16)
    store.write_clustered(df, str(tmp_path / "r"), ["a"], files=16)
    assert rows(spark.read.parquet(str(tmp_path / "z"))) == rows(df)
    assert files_met(tmp_path / "r", "b", 0.1, 0.12) == 16
    assert files_met(tmp_path / "z", "b", 0.1, 0.12) <= 8 and files_met(tmp_path / "z", "a", 100, 110) <= 8
    # Keys of text, one of them hot, and three keys.
    hot = df.withColumn("c", F.when(F.col("b") < 0.4, "hot").otherwise(F.col("c")))
    store.write_zordered(hot, str(tmp_path / "h"), ["c", "a", "b"], files=8)
    assert spark.read.parquet(str(tmp_path / "h")).count() == 40_050
    store.write_zordered(df.limit(0), str(tmp_path / "e"), ["a"], files=4)
    assert spark.read.schema(df.schema).parquet(str(tmp_path / "e")).count() == 0


def test_interleaving_orders_like_plain_bits(spark):
    df = spark.createDataFrame([(a, b) for a in range(16) for b in range(16)], "a int, b int")
    got = store.interleaved(df, {"a": list(range(1, 16)), "b": list(range(1, 16))}, "z", bits=4).collect()
    for r in got:
        assert r.z == int("".join(x + y for x, y in zip(f"{r.a:04b}", f"{r.b:04b}")), 2)


# -- pages as bytes --------------------------------------------------------------------

LATIN = '<html><head><meta charset="{0}"><title>Café «Ø»</title>'


@pytest.mark.parametrize(
    "content,text,charset",
    [
        (LATIN.format("ISO-8859-1").encode("latin-1"), LATIN.format("ISO-8859-1"), "cp1252"),
        (LATIN.format("utf-8").encode(), LATIN.format("utf-8"), "utf-8"),
        ("no declaration é漢".encode(), "no declaration é漢", "utf-8"),
        ("d’accord".encode("cp1252"), "d’accord", "cp1252"),
        (LATIN.format("utf-8").encode("cp1252"), LATIN.format("utf-8"), "cp1252"),  # it says what it isn't
        ('<meta http-equiv="Content-Type" content="text/html; charset=windows-1251">Роза'.encode("cp1251"), None, "cp1251"),
        ('<?xml version="1.0" encoding="Shift_JIS"?>香水'.encode("shift_jis"), None, "shift_jis"),
        (LATIN.format("utf-16").encode(), LATIN.format("utf-16"), "utf-8"),  # readable, so not in two bytes a letter
        (LATIN.format("no-such").encode(), LATIN.format("no-such"), "utf-8"),
        (LATIN.format("rot13").encode(), LATIN.format("rot13"), "utf-8"),
        (b"\xef\xbb\xbfm\xc3\xa9", "mé", "utf-8"),
        ("ü漢".encode("utf-16"), "ü漢", "utf-16-le"),
        (b"\xfe\xff" + "ü漢".encode("utf-16-be"), "ü漢", "utf-16-be"),
        ("ü漢".encode("utf-32"), "ü漢", "utf-32-le"),
        (b"", "", "utf-8"),
        (b"\x81\xff", "�ÿ", "cp1252"),
    ],
)
def test_encoding_of_a_page(content, text, charset):
    assert pages.decoded(content) == (text if text is not None else content.decode(charset), charset)


def test_page_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "1.html").write_bytes("é".encode())
    (tmp_path / "2.html").write_bytes("é".encode("cp1252"))
    (tmp_path / "3.txt").write_bytes(b"no page")
    found = pages.read_pages(spark, str(tmp_path)).collect()
    assert sorted((r.path.rsplit("/", 1)[1], r.html, r.charset) for r in found) == [("1.html", "é", "utf-8"), ("2.html", "é", "cp1252")]
    nothing = spark.createDataFrame([(1, None)], "html int, content binary")
    assert [tuple(r) for r in pages.decode_pages(nothing, html="page").collect()] == [(1, None, None)]


# -- older pages ------------------------------------------------------------------------

OLD = """<html><head><meta property="og:url" content="https://h/perfume/Old-House/Night-Rose-77.html"></head>
<div class="cell accord-box"> woody </div><div class="cell accord-box">rose</div>
<div class="cell small-12" itemprop="description"> Made For Women and Men, they say. </div>
<span itemprop="ratingValue"> 4.1</span><span itemprop="ratingCount">12</span></html>"""


def test_older_page_to_a_whole_record(spark):
    df = spark.createDataFrame([(1, OLD), (2, "<p>nothing</p>"), (3, None), (4, OLD.replace("Old-House", "Other"))], "url int, html string")
    got = [r.asDict() for r in legacy_pages_to_raw(df, "Old-House").collect()]
    assert got[0] == {
        "url": "https://h/perfume/Old-House/Night-Rose-77.html", "name": "Night Rose", "gender": "for women and men",
        "rating": "4.1", "rating_count": "12", "main_accords": ["woody", "rose"], "perfumers": [],
        "description": "Made For Women and Men, they say.", "id": "77", "brand": "Old House",
    }
    assert got[1] == got[2] == {
        "url": None, "name": "N/A", "gender": "N/A", "rating": "N/A", "rating_count": "N/A", "main_accords": [],
        "perfumers": [], "description": "N/A", "id": None, "brand": None,
    }
    assert (got[3]["name"], got[3]["id"], got[3]["brand"], got[3]["rating"]) == ("N/A", None, None, "4.1")
    # Such records go into the layers like others.
    empty = ingest.Layers(*(spark.createDataFrame([], s) for s in (schema.RAW, schema.CLEAN, schema.EMBEDDINGS)))
    records = legacy_pages_to_raw(df.filter("url = 1"), "Old-House").select(*schema.RAW.names)
    assert [(r.id, r.status) for r in ingest.ingest(records, empty, HashingEncoder(8)).status.collect()] == [("77", "added")]


# -- arriving files ----------------------------------------------------------------------


def test_arrivals_equal_one_bulk_ingest(spark, tmp_path):
    encoder = HashingEncoder(8)
    record = "url string, main_accords array<string>, description string, gender string"
    kind = T.StructType.fromDDL(record)

    def made(numbers, accord):
        rows = [(f"https://h/perfume/b/n-{i}.html", [accord], "Top notes are x.", "men") for i in numbers]
        return spark.createDataFrame(rows, kind)

    def stored(root):
        return jobs.Store(f"{root}/raw", f"{root}/clean", f"{root}/embeddings")

    def state(store):
        layers = store.read(spark)
        return [rows(df) for df in (layers.raw, layers.clean, layers.embeddings)]

    batches = [made(range(6), "a"), made(range(4, 9), "b")]
    bulk = stored(tmp_path / "bulk")
    for batch in batches:
        jobs.run_ingest(spark, bulk, batch, encoder)

    where, folder = stored(tmp_path / "stream"), str(tmp_path / "in")

    def run():
        return arriving.run_arriving(
            spark, where, folder, kind, encoder, str(tmp_path / "checkpoint"), str(tmp_path / "reports")
        )

    for batch in batches:
        batch.coalesce(1).write.mode("append").parquet(folder)
        assert run() == 1
    assert run() == 0
    assert state(where) == state(bulk) and len(state(where)[0]) == 9
    report = arriving.read_reports(spark, str(tmp_path / "reports"))
    assert {(r["batch"], r.status): r["count"] for r in report.groupBy("batch", "status").count().collect()} == {
        (0, "added"): 6, (1, "added"): 3, (1, "updated"): 2,
    }

    # A batch that is repeated changes nothing, whether or not its report was finished.
    before = state(where)
    assert not arriving.ingest_batch(where, batches[1], 1, encoder, str(tmp_path / "reports"))
    (tmp_path / "reports" / "batch=1" / "_SUCCESS").unlink()
    assert arriving.ingest_batch(where, batches[1], 1, encoder, str(tmp_path / "reports"))
    assert state(where) == before
