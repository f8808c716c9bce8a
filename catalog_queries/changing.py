"""Anti-joins, upserts, deletes and change classification.

The older state of the documents is their labelled part: an unlabelled
document is new, a toxic one was never embedded, and one of low quality was
embedded from another text.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog_engine import runtime
from catalog_engine.operators import changes
from catalog_engine.operators.upsert import delete_cascade, upsert
from catalog_engine.plans import jobs
from catalog_queries.tables import table


def _stored(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text", "source")
    labels = table(spark, sf, "labels")
    old = F.when(F.col("toxic") == 1, None).when(F.col("quality") == 1, F.col("text")).otherwise(
        F.concat("source", F.lit(" "), "text")
    )
    return docs.join(labels, "doc_id").select("doc_id", old.alias("text"))


def anti_new(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    return changes.new_rows(docs, table(spark, sf, "labels"), "doc_id")


def stale_rows(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    return changes.stale_rows(docs, _stored(spark, sf), "doc_id", "text").select("doc_id", "lang")


def classify_changes(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    out = changes.classify_changes(docs, table(spark, sf, "labels"), _stored(spark, sf), "doc_id", "text")
    return out.select("doc_id", "status", "needs_embedding")


def existing_state(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id")
    out = changes.existing_state(docs, table(spark, sf, "labels"), _stored(spark, sf), "doc_id", "text")
    return out.select("doc_id", "in_clean", F.length("stored_text").cast("double").alias("stored_length"))


def semi_in(spark, sf):
    keys = table(spark, sf, "customer").filter(F.col("c_mktsegment") == "BUILDING").select("c_custkey")
    out = changes.rows_in(table(spark, sf, "orders"), keys, "o_custkey", "c_custkey")
    return out.select("o_orderkey", "o_custkey", "o_orderstatus")


def scalar_eq(spark, sf):
    dearest = table(spark, sf, "orders").agg(F.max_by("o_custkey", F.struct("o_totalprice", "o_orderkey")).alias("k"))
    orders = table(spark, sf, "orders")
    return changes.rows_in(orders, dearest, "o_custkey", "k").select("o_orderkey", "o_custkey")


def _relabelled(spark, sf):
    """A label for every long document."""
    return table(spark, sf, "documents").filter(F.col("n_chars") > 1000).select(
        "doc_id", F.when(F.col("lang") == "en", 1).otherwise(0).alias("quality"), F.lit(0).alias("toxic")
    )


def upsert_all(spark, sf):
    return upsert(table(spark, sf, "labels"), _relabelled(spark, sf), "doc_id")


def upsert_partitions(spark, sf):
    """The same into a stored table, of which each language's batch rewrites the partitions that it meets."""
    fresh = table(spark, sf, "documents").select("doc_id", "lang").join(_relabelled(spark, sf), "doc_id")
    labels = table(spark, sf, "labels")
    stored = jobs.Table(runtime.scratch_path(spark, "partitions"), labels.schema, "doc_id", partitions=16)
    stored.publish(labels)
    for english in (F.col("lang") == "en", ~F.col("lang").eqNullSafe("en")):
        batch = runtime.broadcast_if_small(runtime.checkpointed(fresh.filter(english).drop("lang")))
        stored.merge(stored.read(spark), batch)
    return stored.read(spark)


def upsert_cols(spark, sf):
    out = upsert(
        table(spark, sf, "labels"), _relabelled(spark, sf), "doc_id", update_cols=["quality"],
        insert_cols=["doc_id", "quality"],
    )
    return out.withColumn("toxic", F.col("toxic").cast("double"))


def upsert_orders(spark, sf):
    """Orders take the number of their returned lines as priority."""
    returned = (
        table(spark, sf, "lineitem")
        .filter(F.col("l_returnflag") == "R")
        .groupBy(F.col("l_orderkey").alias("o_orderkey"))
        .agg(F.count(F.lit(1)).cast("string").alias("o_orderpriority"))
    )
    return upsert(table(spark, sf, "orders"), returned, "o_orderkey", update_cols=["o_orderpriority"]).select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"
    )


def delete_cascade_query(spark, sf):
    customer, orders, lineitem = (table(spark, sf, t) for t in ("customer", "orders", "lineitem"))
    gone = customer.filter(F.col("c_mktsegment") == "BUILDING").select(F.col("c_custkey"))
    gone_orders = orders.join(gone, F.col("o_custkey") == F.col("c_custkey"), "left_semi")
    left = delete_cascade(
        {"customer": (customer, "c_custkey"), "orders": (orders, "o_custkey")},
        gone.withColumn("o_custkey", F.col("c_custkey")),
    ) | delete_cascade(
        {"lineitem": (lineitem, "l_orderkey")}, gone_orders.select(F.col("o_orderkey").alias("l_orderkey"))
    )
    rows = [
        left[t].select(F.lit(t).alias("table_name"), F.col(k).alias("key"), F.col(line).alias("line"))
        for t, k, line in (
            ("customer", "c_custkey", "c_nationkey"),
            ("orders", "o_orderkey", "o_orderstatus"),
            ("lineitem", "l_orderkey", "l_linenumber"),
        )
    ]
    rows = [r.withColumn("line", F.col("line").cast("string")) for r in rows]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


QUERIES = {
    f.__name__: f
    for f in (
        anti_new, stale_rows, classify_changes, existing_state, semi_in, scalar_eq,
        upsert_all, upsert_partitions, upsert_cols, upsert_orders,
    )
} | {"delete_cascade": delete_cascade_query}

_STORED = """stored AS (
  SELECT d.doc_id, CASE WHEN toxic = 1 THEN NULL WHEN quality = 1 THEN text ELSE source || ' ' || text END AS text
  FROM documents d JOIN labels l ON l.doc_id = d.doc_id)"""

_RELABELLED = """fresh AS (SELECT doc_id, CASE WHEN lang = 'en' THEN 1 ELSE 0 END AS quality, 0 AS toxic
  FROM documents WHERE n_chars > 1000)"""

SQL = {
    "anti_new": "SELECT doc_id, lang, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "stale_rows": f"""WITH {_STORED}
SELECT d.doc_id, lang FROM documents d LEFT JOIN stored s ON s.doc_id = d.doc_id
WHERE d.text IS NOT NULL AND (s.doc_id IS NULL OR d.text IS DISTINCT FROM s.text)""",
    "classify_changes": f"""WITH {_STORED},
c AS (
  SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'added' WHEN s.text IS NULL THEN 'unembedded'
    WHEN s.text = d.text THEN 'unchanged' ELSE 'updated' END AS status
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id LEFT JOIN stored s ON s.doc_id = d.doc_id)
SELECT doc_id, status, status <> 'unchanged' AS needs_embedding FROM c""",
    "existing_state": f"""WITH {_STORED}
SELECT d.doc_id, l.doc_id IS NOT NULL AS in_clean, length(s.text)::DOUBLE AS stored_length
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id LEFT JOIN stored s ON s.doc_id = d.doc_id""",
    "semi_in": """SELECT o_orderkey, o_custkey, o_orderstatus FROM orders
WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""",
    "scalar_eq": """SELECT o_orderkey, o_custkey FROM orders
WHERE o_custkey = (SELECT o_custkey FROM orders ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 1)""",
    "upsert_all": f"""WITH {_RELABELLED}
SELECT doc_id, quality, toxic FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM fresh)
UNION ALL SELECT doc_id, quality, toxic FROM fresh""",
    "upsert_partitions": f"""WITH {_RELABELLED}
SELECT doc_id, quality, toxic FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM fresh)
UNION ALL SELECT doc_id, quality, toxic FROM fresh""",
    "upsert_cols": f"""WITH {_RELABELLED}
SELECT l.doc_id, CASE WHEN f.doc_id IS NOT NULL THEN f.quality ELSE l.quality END AS quality, l.toxic::DOUBLE AS toxic
FROM labels l LEFT JOIN fresh f ON f.doc_id = l.doc_id
UNION ALL SELECT doc_id, quality, NULL FROM fresh WHERE doc_id NOT IN (SELECT doc_id FROM labels)""",
    "upsert_orders": """WITH r AS (SELECT l_orderkey, count(*)::VARCHAR AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL)
SELECT o_orderkey, o_custkey, o_orderstatus, coalesce(n, o_orderpriority) AS o_orderpriority
FROM orders LEFT JOIN r ON l_orderkey = o_orderkey
UNION ALL SELECT l_orderkey, NULL, NULL, n FROM r WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)""",
    "delete_cascade": """WITH gone AS (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'),
gone_orders AS (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM gone))
SELECT 'customer' AS table_name, c_custkey AS key, c_nationkey::VARCHAR AS line FROM customer
WHERE c_custkey NOT IN (SELECT c_custkey FROM gone)
UNION ALL SELECT 'orders', o_orderkey, o_orderstatus FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM gone)
UNION ALL SELECT 'lineitem', l_orderkey, l_linenumber::VARCHAR FROM lineitem
WHERE l_orderkey NOT IN (SELECT o_orderkey FROM gone_orders)""",
}
