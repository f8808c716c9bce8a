"""Encoding, embedding runs, ingest, and the driver contract."""

import os
import subprocess
import sys

import numpy as np
import pytest

import catalog_queries
from catalog_engine import schema
from catalog_engine.functions import text
from catalog_engine.operators import changes
from catalog_engine.operators.encode import HashingEncoder, encode
from catalog_engine.plans import embed as E
from catalog_engine.plans.clean import clean_items
from catalog_engine.plans.ingest import Layers, entered, ingest, remove

ENCODER = HashingEncoder(16)
REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_hashing_encoder():
    m = ENCODER.encode(["rose musk", "Musk  rose", "", "amber"])
    assert m.shape == (4, 16)
    assert (m[0] == m[1]).all()  # word order and case do not matter
    assert np.allclose(np.linalg.norm(m, axis=1), [1, 1, 0, 1])
    assert (HashingEncoder(16).encode(["rose musk"]) == m[:1]).all()


def test_encoder_splits_long_batches(monkeypatch):
    texts = ["rose musk " * i for i in range(50)]
    whole = ENCODER.encode(texts)
    monkeypatch.setattr(HashingEncoder, "CHARS", 64)
    assert (ENCODER.encode(texts) == whole).all()


def test_encode_column(spark):
    df = spark.createDataFrame([(1, "rose musk"), (2, None), (3, ""), (4, "rose musk")], "id long, t string")
    got = {r.id: r.embedding for r in encode(df, "t", ENCODER).collect()}
    assert got[2] is None and got[3] == [0.0] * 16
    assert got[1] == got[4] and np.allclose(got[1], ENCODER.encode(["rose musk"])[0])
    assert dict(encode(df, "t", ENCODER).dtypes)["embedding"] == "array<float>"


def test_other_encoders_plug_in(spark):
    def lengths():
        return lambda texts: np.array([[len(t), 1.0] for t in texts])

    df = spark.createDataFrame([("abc",)], "t string")
    assert encode(df, "t", lengths).first().embedding == [3.0, 1.0]


ITEMS = [("1", "a b"), ("2", "c"), ("3", ""), ("4", None), ("x9", "d"), (None, "e"), ("5", "f")]


@pytest.fixture
def items(spark):
    return spark.createDataFrame(ITEMS, "id string, perfume_string string")


@pytest.fixture
def stored(spark):
    return spark.createDataFrame([(2, "old", [9.0], "p"), (7, "gone", [7.0], "q")], "id long, perfume_string string, embedding array<float>, partition_key string")


def test_embed_new_only(items, stored):
    got = E.embed(items, stored, ENCODER, mode="new")
    assert rows(got.select("id", "perfume_string")) == [(1, "a b"), (2, "old"), (5, "f"), (7, "gone")]


def test_embed_changed(items, stored):  # D6, D7, D8
    got = E.embed(items, stored, ENCODER, mode="changed")
    assert rows(got.select("id", "perfume_string", "partition_key")) == [
        (1, "a b", None), (2, "c", "p"), (5, "f", None), (7, "gone", "q"),
    ]
    assert got.filter("id = 2").first().embedding != [9.0]
    assert sorted(r.id or "" for r in E.rejected_keys(items, "id").collect()) == ["", "x9"]


@pytest.mark.parametrize("mode", ["new", "changed"])
def test_embed_twice_changes_nothing(items, stored, mode):
    once = E.embed(items, stored, ENCODER, mode=mode)
    assert E.rows_to_embed(items, once, mode).count() == 0
    assert rows(E.embed(items, once, ENCODER, mode=mode)) == rows(once)


def test_only_rows_to_embed_reach_the_encoder(spark, items, stored, tmp_path):
    stored.write.parquet(str(tmp_path / "stored"))
    on_disk = spark.read.parquet(str(tmp_path / "stored"))
    plan = E.new_embeddings(items, on_disk, ENCODER)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("ArrowEvalPython") < plan.index("LeftSemi")  # printed top down
    assert "BuildRight" in plan  # the short list is broadcast

    ready = E.with_long_key(items, "id", "perfume_string")
    found = changes.stale_rows(ready, on_disk, "id", "perfume_string").select("id")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<id:bigint,perfume_string:string>" in plan  # vectors are not read


def test_unknown_mode(items, stored):
    with pytest.raises(ValueError):
        E.embed(items, stored, ENCODER, mode="all")


RECORD = "url string, name string, gender string, rating double, rating_count int, main_accords array<string>, perfumers array<string>, description string"


def record(n, notes="Rose and Musk", **more):
    url = f"https://www.example.com/perfume/House/Item-{n}.html"
    base = dict(
        url=url, name=f"Item {n}", gender="for men", rating=4.5, rating_count=10, main_accords=["warm spicy"],
        perfumers=["P"], description=f"Item {n} was launched in 2001. Top notes are {notes}.",
    )
    return tuple((base | more).values())


def test_ingest_and_remove(spark):
    def layer(records):
        raw = spark.createDataFrame(records, RECORD)
        from catalog_engine.operators.extract import stringify

        raw = stringify(raw, schema.RAW.names)
        clean = clean_items(raw)
        emb = encode(clean.select(text.to_key("id").alias("id"), "perfume_string"), "perfume_string", ENCODER)
        return raw, clean, emb

    raw, clean, emb = layer([record(n) for n in (1, 2, 3)])
    layers = Layers(raw, clean, emb.filter("id <> 3"))
    incoming = [record(1), record(2, "Lily"), record(3), record(4), record(5, url="https://no.id/x")]
    done = ingest(spark.createDataFrame(incoming, RECORD), layers, ENCODER)

    assert rows(done.status.select("id", "status", "needs_embedding")) == [
        ("1", "unchanged", False), ("2", "updated", True), ("3", "unembedded", True), ("4", "added", True),
        (None, "rejected", False),
    ]
    after = done.layers
    assert after.raw.columns == schema.RAW.names and after.raw.count() == 5
    got = {r.id: r for r in after.clean.collect()}
    assert set(got) == {"1", "2", "3", "4"}
    assert got["2"].top_notes == "lily" and got["2"].rating_count == 10  # kept from the bulk run
    assert got["4"].rating is None and got["4"].gender == "men"
    vec = {r.id: r for r in after.embeddings.collect()}
    assert set(vec) == {1, 2, 3, 4}
    for r in vec.values():
        assert np.allclose(r.embedding, ENCODER.encode([r.perfume_string])[0])

    again = ingest(spark.createDataFrame(incoming, RECORD), after, ENCODER)
    assert {r.status for r in again.status.collect()} == {"unchanged", "rejected"}
    assert rows(again.layers.clean) == rows(after.clean)

    left = remove(after.clean.filter("id = '2'").select("id", "url"), after)
    assert left.raw.count() == 4 and left.clean.count() == 3 and left.embeddings.count() == 3


def test_two_addresses_with_one_id(spark):  # D20
    records = [record(1), record(1, url="https://www.example.com/perfume/Alias/Item-1.html")]
    empty = Layers(
        spark.createDataFrame([], schema.RAW), spark.createDataFrame([], schema.CLEAN), spark.createDataFrame([], schema.EMBEDDINGS)
    )
    done = ingest(spark.createDataFrame(records, RECORD), empty, ENCODER)
    assert done.layers.raw.count() == 2
    assert [r.brand for r in done.layers.clean.collect()] == ["House"]


def empty_layers(spark):
    return Layers(*[spark.createDataFrame([], s) for s in (schema.RAW, schema.CLEAN, schema.EMBEDDINGS)])


def test_every_record_is_reported(spark):
    address = "https://www.example.com/perfume/{}/Item-{}.html"
    incoming = [
        record(1, rating=None, description="N/A", main_accords=[]),  # nothing to embed
        record(2, url=address.format("House", "x9")),  # no number
        record(3, url="https://no.id/x"),
        record(4, url=None),
        record(5, url=None),
        record(6),
        record(6, url=address.format("Alias", 6)),
    ]
    done = ingest(spark.createDataFrame(incoming, RECORD), empty_layers(spark), ENCODER)
    got = sorted((r.id or "", r.status, r.reason or "", r.needs_embedding) for r in done.status.collect())
    assert got == [
        ("", "rejected", "no address", False),
        ("", "rejected", "no address", False),
        ("", "rejected", "no id in the address", False),
        ("1", "added", "nothing to embed", False),
        ("6", "added", "", True),
        ("6", "rejected", "id of another record", False),
        ("x9", "added", "id is not a number", False),
    ]
    assert done.status.filter("id = '1'").first().missing_fields == ["rating", "main_accords", "description"]
    assert done.layers.raw.count() == 7
    assert sorted(r.id for r in done.layers.clean.collect()) == ["1", "6", "x9"]
    assert [r.id for r in done.layers.embeddings.collect()] == [6]


def test_no_records(spark):
    done = ingest(spark.createDataFrame([], RECORD), empty_layers(spark), ENCODER)
    assert done.status.count() == done.layers.raw.count() == done.layers.embeddings.count() == 0


def test_manual_entry_keeps_other_columns(spark):
    stored = ingest(spark.createDataFrame([record(1), record(2)], RECORD), empty_layers(spark), ENCODER).layers
    url = record(1)[0]
    forms = [(url, "\nwarm spicy\n amber \n", "Item 1 was launched in 2002. Base note is Musk.", "women")]
    forms.append((url.replace("1", "3"), "amber", "", None))
    forms = spark.createDataFrame(forms, "url string, main_accords string, description string, gender string")
    after = ingest(entered(forms), stored, ENCODER).layers
    raw = {r.url: r for r in after.raw.collect()}
    assert len(raw) == 3 and raw[url].rating == "4.5" and raw[url].name == "Item 1"
    assert raw[url].main_accords == "['warm spicy', 'amber']"
    clean = {r.id: r for r in after.clean.collect()}
    assert clean["1"].accords == "warm spicy, amber" and clean["1"].perfumers == "P" and clean["1"].gender == "women"
    assert clean["1"].release_year == "2002" and clean["3"].accords == "amber"
    assert after.embeddings.count() == 3
    with pytest.raises(ValueError, match="description"):
        ingest(entered(forms).drop("description"), stored, ENCODER)


@pytest.mark.parametrize("mode", ["new", "changed"])
def test_keys_that_are_one_number(spark, mode):
    items = spark.createDataFrame(
        [("7", "old", "a"), ("007", "best", "b"), ("8", "x", None), ("8", "y", "c")],
        "id string, perfume_string string, url string",
    )
    stored = spark.createDataFrame([(7, "old", [1.0])] if mode == "changed" else [], schema.EMBEDDINGS)
    got = E.embed(items, stored, ENCODER, mode=mode, prefer="url")
    assert rows(got.select("id", "perfume_string")) == [(7, "best"), (8, "y")]
    assert E.rows_to_embed(items, got, mode, prefer="url").count() == 0


def test_jobs_over_partitions_equal_jobs_over_whole_versions(spark):
    from catalog_engine import runtime
    from catalog_engine.operators.extract import stringify
    from catalog_engine.plans import jobs
    from catalog_engine.sources import partitions

    def files(spark, root):
        return {p: sorted(os.listdir(path.removeprefix("file:"))) for p, path in partitions.folders(spark, root).items()}

    found = []
    for n in (None, 16):
        root = runtime.scratch_path(spark, "jobs")
        store = jobs.Store(f"{root}/raw", f"{root}/clean", f"{root}/embeddings", partitions=n)
        first = spark.createDataFrame([record(i) for i in range(40)], RECORD)
        store.raw_table.publish(stringify(first, schema.RAW.names))
        assert jobs.run_clean(spark, store) == 40 and jobs.run_embed(spark, store, ENCODER) == 40
        before = n and files(spark, store.embeddings)
        incoming = spark.createDataFrame([record(2, "Lily"), record(50)], RECORD)
        status = jobs.run_ingest(spark, store, incoming, ENCODER)
        assert rows(status.select("id", "status")) == [("2", "updated"), ("50", "added")]
        if n:
            after = files(spark, store.embeddings)
            assert 1 <= sum(before.get(p) != v for p, v in after.items()) <= 2
        layers = store.read(spark)
        jobs.run_remove(spark, store, layers.clean.filter("id in (1, 3)").select("id", "url"))
        assert jobs.run_embed(spark, store, ENCODER, mode="changed") == 0
        layers = store.read(spark)
        found.append([rows(df) for df in (layers.raw, layers.clean, layers.embeddings)])
        assert [len(x) for x in found[-1]] == [39, 39, 39]
    assert found[0] == found[1]


def test_jobs_over_stored_tables(spark):
    from catalog_engine import runtime
    from catalog_engine.operators.extract import stringify
    from catalog_engine.plans import jobs
    from catalog_engine.sources import tables

    root = runtime.scratch_path(spark, "jobs")
    store = jobs.Store(f"{root}/raw", f"{root}/clean", f"{root}/embeddings")

    def versions(where):
        return int(tables.current_path(spark, where).rsplit("=", 1)[1])

    first = spark.createDataFrame([record(1), record(2)], RECORD)
    tables.publish(stringify(first, schema.RAW.names), store.raw)
    assert jobs.run_clean(spark, store, csv_path=f"{root}/csv") == 2
    assert spark.read.csv(f"{root}/csv", header=True).columns == schema.CLEAN.names
    assert jobs.run_embed(spark, store, ENCODER) == 2
    assert jobs.run_embed(spark, store, ENCODER) == 0
    assert jobs.run_embed(spark, store, ENCODER, mode="changed") == 0
    assert versions(store.embeddings) == 1

    # Only new items: rows are appended, nothing is rewritten.
    status = jobs.run_ingest(spark, store, spark.createDataFrame([record(3)], RECORD), ENCODER)
    assert rows(status.select("id", "status")) == [("3", "added")]
    assert [versions(w) for w in (store.raw, store.clean, store.embeddings)] == [1, 1, 1]

    status = jobs.run_ingest(spark, store, spark.createDataFrame([record(2, "Lily"), record(3)], RECORD), ENCODER)
    assert rows(status.select("id", "status")) == [("2", "updated"), ("3", "unchanged")]
    layers = store.read(spark)
    assert (layers.raw.count(), layers.clean.count(), layers.embeddings.count()) == (3, 3, 3)
    assert layers.clean.filter("id = '2'").first().top_notes == "lily"
    for r in layers.embeddings.collect():
        assert np.allclose(r.embedding, ENCODER.encode([r.perfume_string])[0])

    jobs.run_remove(spark, store, layers.clean.filter("id = '1'").select("id", "url"))
    layers = store.read(spark)
    assert (layers.raw.count(), layers.clean.count(), layers.embeddings.count()) == (2, 2, 2)
    assert tables.compact(spark, store.clean, ["id"], files=2) == 2


def test_entry(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.columns == ["vec_id", "similarity", "label"] and df.count() == 5
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalog_queries.QUERIES) <= set(entry.oracle_sql())


def test_workers_need_no_checkout(tmp_path):
    """From another folder, with the packages on the driver's path only."""
    code = (
        f"import sys; sys.path.insert(0, {REPO!r})\n"
        "import __spark_entry__ as e\n"
        "from pyspark.sql import SparkSession\n"
        "s = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').getOrCreate()\n"
        "print(e.entry(s).count(), e.queries()['html_fields'](s, '/root/testdata/sf0.001').count(),\n"
        "      e.queries()['search_terms'](s, '/root/testdata/sf0.001').count() > 0)\n"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert out.stdout.split() == ["5", "50", "True"], out.stderr[-2000:]


def test_a_cluster_must_name_its_shared_folder():
    from unittest.mock import MagicMock

    from catalog_engine import runtime

    session = MagicMock()
    session.conf.get.return_value = None
    session.sparkContext.getCheckpointDir.return_value = None
    session.sparkContext.master = "spark://host"
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        runtime.shared_dir(session)
    session.conf.get.return_value = "hdfs:///shared"
    assert runtime.shared_dir(session) == "hdfs:///shared"
    session.sparkContext.setCheckpointDir.assert_called_once_with("hdfs:///shared")
