"""Sources and sinks: what was written is read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalog_engine import runtime
from catalog_engine.operators import quality
from catalog_engine.operators.keys import unlisted
from catalog_engine.operators.upsert import upsert
from catalog_engine.sources import tables as store
from catalog_queries.tables import table

NOTES = [(0, "O'Neil -- \"first\""), (1, "a; DROP"), (2, None), (9, "nowhere")]


def inline_params(spark, sf):
    """Hand-entered rows as a view, joined with bound parameters."""
    table(spark, sf, "nation").createOrReplaceTempView("inline_params_nation")
    store.inline_rows(spark, NOTES, "region int, note string", view="inline_params_notes")
    return spark.sql(
        """SELECT n_nationkey, n_name, note, :mark AS mark
        FROM inline_params_nation LEFT JOIN inline_params_notes ON region = n_regionkey
        WHERE n_name <> :skip""",
        args={"mark": 'it\'s "quoted" -- text', "skip": "NATION_3"},
    )


def csv_roundtrip(spark, sf):
    """Whole documents, with their quotes, line breaks and white space at both ends, through CSV."""
    path = runtime.scratch_path(spark, "csv")
    padded = F.concat(F.lit("  "), "text", F.lit(" \t"))
    docs = table(spark, sf, "documents").withColumn("text", padded)
    store.write_csv(docs.select("doc_id", "text", "lang"), path)
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ("doc_id", "text", "lang")])
    return store.read_raw_csv(spark, path, schema, multi_line=True).select(
        F.col("doc_id").try_cast("bigint").alias("doc_id"), F.md5("text").alias("text_md5"), "lang"
    )


def clustered_write(spark, sf):
    path = runtime.scratch_path(spark, "clustered")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    store.write_clustered(orders, path, ["o_orderkey"], files=8)
    return store.read_table(spark, path)


def publish_append(spark, sf):
    """A table that is published, widened by a second version and appended to."""
    root = runtime.scratch_path(spark, "labels")
    labels = table(spark, sf, "labels")
    docs = table(spark, sf, "documents")
    store.publish(labels, root)
    known = store.read_current(spark, root)
    store.publish(known.drop("toxic").withColumns({"origin": F.lit("label"), "lang": F.lit(None).cast("string")}), root)
    known = store.read_current(spark, root)
    store.append(docs.join(known, "doc_id", "left_anti").select("doc_id", "lang"), root)
    numbers = [F.col(c).cast("double").alias(c) for c in ("quality", "toxic")]
    return store.read_current(spark, root).select("doc_id", *numbers, "origin", "lang")


def saved_table(spark, sf):
    """Labels as a bucketed catalog table: appended to, merged into with itself read, and read by its name."""
    name, root = f"labels_{uuid.uuid4().hex}", runtime.scratch_path(spark, "saved")
    docs, labels = (table(spark, sf, t) for t in ("documents", "labels"))
    store.save_table(labels, name, "doc_id", buckets=16, path=f"{root}/0")
    new = unlisted(docs.select("doc_id"), spark.table(name), "doc_id")
    store.append_table(new.withColumn("quality", F.lit(5)), name)
    changed = docs.filter(F.col("lang") == "de").select("doc_id", F.lit(9).alias("toxic"))
    merged = upsert(spark.table(name), changed, "doc_id", ["toxic"])
    store.replace_table(merged, name, "doc_id", 16, path=f"{root}/1")
    numbers = [F.col(c).cast("double").alias(c) for c in ("quality", "toxic")]
    return store.read_table(spark, name, ["doc_id", "quality", "toxic"]).select("doc_id", *numbers)


def lookup_bloom(spark, sf):
    """Orders of some customers and some orders by key, from files that hold filters of both."""
    path = runtime.scratch_path(spark, "lookup")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    store.write_lookup(orders, path, ["o_orderkey", "o_custkey"], distinct=100_000)
    found = store.read_table(spark, path).filter((F.col("o_custkey") == 77) | F.col("o_orderkey").isin(5, 700, 10**9))
    return found


def zorder_write(spark, sf):
    """Orders in files by customer and price at once, of which a filter on either reads a few."""
    path = runtime.scratch_path(spark, "zorder")
    store.write_zordered(
        table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), path, ["o_custkey", "o_totalprice"], files=16
    )
    both = store.read_table(spark, path)
    cheap = both.filter(F.col("o_totalprice") < 2000).select("o_orderkey", F.lit("cheap").alias("why"))
    return cheap.unionByName(both.filter(F.col("o_custkey") < 50).select("o_orderkey", F.lit("early").alias("why")))


def vocabulary_json(spark, sf):
    """The words of all part names and brands, through JSON."""
    path = runtime.scratch_path(spark, "vocabulary")
    words = table(spark, sf, "part").select(F.translate("p_name", " ", ",").alias("name"), F.col("p_brand").alias("brand"))
    store.write_json(quality.vocabulary(words, ["name", "brand"]), path)
    return spark.read.json(path, schema="field string, term string")


QUERIES = {
    f.__name__: f
    for f in (
        inline_params, csv_roundtrip, clustered_write, publish_append, saved_table, lookup_bloom, zorder_write, vocabulary_json,
    )
}

SQL = {
    "vocabulary_json": """SELECT DISTINCT 'name' AS field, unnest(string_split(p_name, ' ')) AS term FROM part
UNION SELECT 'brand', p_brand FROM part""",
    "inline_params": """SELECT n_nationkey, n_name, note, 'it''s "quoted" -- text' AS mark
FROM nation LEFT JOIN (VALUES (0, 'O''Neil -- "first"'), (1, 'a; DROP'), (2, NULL), (9, 'nowhere')) t(region, note)
  ON region = n_regionkey WHERE n_name <> 'NATION_3'""",
    "csv_roundtrip": "SELECT doc_id, md5('  ' || text || ' ' || chr(9)) AS text_md5, lang FROM documents",
    "clustered_write": "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders",
    "saved_table": """SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 5 ELSE quality END::DOUBLE AS quality,
  CASE WHEN lang = 'de' THEN 9 ELSE toxic END::DOUBLE AS toxic
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""",
    "lookup_bloom": """SELECT o_orderkey, o_custkey, o_orderstatus FROM orders
WHERE o_custkey = 77 OR o_orderkey IN (5, 700, 1000000000)""",
    "zorder_write": """SELECT o_orderkey, 'cheap' AS why FROM orders WHERE o_totalprice < 2000
UNION ALL SELECT o_orderkey, 'early' FROM orders WHERE o_custkey < 50""",
    "publish_append": """SELECT doc_id, quality::DOUBLE AS quality, CAST(NULL AS DOUBLE) AS toxic, 'label' AS origin, CAST(NULL AS VARCHAR) AS lang FROM labels
UNION ALL SELECT doc_id, NULL, NULL, NULL, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""",
}
