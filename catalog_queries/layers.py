"""Encoding, the embedding jobs and the add/update job over all layers.

The layers start from an older record of every part: the clean layer lacks the
PROMO items, and of those it has the STANDARD ones are not embedded yet.
Incoming is one fresh record for every part.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog_engine import runtime
from catalog_engine import schema as schemas
from catalog_engine.functions import sql, text
from catalog_engine.operators import changes
from catalog_engine.operators.encode import HashingEncoder, encode
from catalog_engine.operators.extract import stringify
from catalog_engine.plans import arriving
from catalog_engine.plans import clean as cleaning
from catalog_engine.plans import embed as embedding
from catalog_engine.plans import ingest as ingesting
from catalog_engine.plans import jobs
from catalog_engine.plans import recommend as recommending
from catalog_engine.sources import tables as store
from catalog_queries.finding import scores_sql
from catalog_queries.pages import ITEM_PAGES_SQL, item_page_table
from catalog_queries.tables import (
    ITEM_ACCORDS_SQL,
    ITEM_GENDER_SQL,
    ITEM_TITLE_SQL,
    ITEM_URL_SQL,
    RAW_ITEMS_SQL,
    clean_items_sql,
    hash_vectors_sql,
    tag_bag_sql,
    item_accords,
    item_gender,
    item_prose,
    item_prose_sql,
    item_title,
    item_url,
    raw_items,
    table,
    vector_text,
)

DIMS = 32  # of the built-in encoder; any size works alike
ENCODER = HashingEncoder(DIMS)


def encode_hash(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return encode(docs, "text", ENCODER).select("doc_id", vector_text("embedding").alias("embedding"))


def _records(spark, sf, base):
    """One scraped record for every part."""
    return runtime.spread(table(spark, sf, "part")).select(
        item_url().alias("url"),
        item_title().alias("name"),
        item_gender().alias("gender"),
        F.col("p_size").cast("double").alias("rating"),
        F.col("p_size").alias("rating_count"),
        item_accords().alias("main_accords"),
        F.array(F.translate("p_brand", "#", " ")).alias("perfumers"),
        item_prose(F.lit(1999), base).alias("description"),
    )


def _incoming(spark, sf):
    return _records(spark, sf, F.lit(""))


def _items(spark, sf):
    """The clean layer before any removal; large parts were scraped with another prose."""
    old = _records(spark, sf, F.when(F.col("p_size") > 25, "; base note is Musk").otherwise(""))
    return cleaning.clean_items(stringify(old, schemas.RAW.names), copies=False).filter(F.col("id").isNotNull())


def _stored(spark, name, df):
    """``df`` as a published table."""
    root = runtime.scratch_path(spark, name)
    store.publish(df, root)
    return store.read_current(spark, root)


def _layers(spark, sf, items=None) -> ingesting.Layers:
    """The three layers as published tables, of ``items`` if those are published already."""
    items = items if items is not None else _stored(spark, "items", _items(spark, sf))
    raw = stringify(items.withColumnRenamed("accords", "main_accords"), schemas.RAW.names)
    clean = items.filter(~F.col("accords").contains("promo"))
    ready = clean.filter(~F.col("accords").contains("standard"))
    vectors = encode(ready.select(text.to_key("id").alias("id"), "perfume_string"), "perfume_string", ENCODER)
    return ingesting.Layers(raw, clean, _stored(spark, "embeddings", vectors))


def _show(vectors):
    return vectors.select("id", "perfume_string", vector_text("embedding").alias("embedding"))


def embed_new(spark, sf):
    items = _stored(spark, "items", _items(spark, sf))
    stored = _layers(spark, sf, items).embeddings
    return _show(embedding.embed(items, stored, ENCODER, mode="new"))


def embed_changed(spark, sf):
    stored = _layers(spark, sf).embeddings
    incoming = cleaning.clean_items(stringify(_incoming(spark, sf), schemas.RAW.names), copies=False)
    return _show(embedding.embed(_stored(spark, "incoming", incoming), stored, ENCODER, mode="changed"))


def _ingested(spark, sf):
    return ingesting.ingest(_incoming(spark, sf), _layers(spark, sf), ENCODER)


def ingest(spark, sf):
    return _report(_ingested(spark, sf))


def _report(done):
    return done.status.withColumn("missing_fields", F.array_join("missing_fields", ", "))


def pages_to_layers(spark, sf):
    """Item pages through parsing, cleaning and classification into the layers: the report."""
    return _report(ingesting.ingest_pages(item_page_table(spark, sf), _layers(spark, sf), ENCODER))


def manual_entry(spark, sf):
    """Typed entries for every part: other raw columns of stored records stay."""
    forms = table(spark, sf, "part").select(
        item_url().alias("url"),
        F.concat(F.lit("\n "), F.lower("p_type"), F.lit(" \n\n"), F.lower("p_brand"), F.lit("\n")).alias("main_accords"),
        item_prose(F.lit(2001), F.lit("")).alias("description"),
        F.lit("men").alias("gender"),
    )
    after = ingesting.ingest(ingesting.entered(forms), _layers(spark, sf), ENCODER).layers
    clean = after.clean.select("url", "id", "accords", "release_year", F.col("perfumers").alias("perfumers_clean"), F.col("gender").alias("clean_gender"))
    return after.raw.join(clean, "url", "left")


def embed_shared_ids(spark, sf):
    """Runs over a layer where two brands' addresses share an id and some ids are no numbers."""
    part = table(spark, sf, "part")
    brand = F.translate("p_brand", "#", "-")
    number = F.when(F.col("p_type") == "PROMO", F.concat(F.lit("x"), "p_size")).otherwise(F.col("p_size").cast("string"))
    url = F.concat(F.lit("https://www.example.com/perfume/"), brand, F.lit("/Item-"), number, F.lit(".html"))
    items = cleaning.clean_items(
        stringify(part.select(url.alias("url"), F.array("p_type").alias("main_accords")), schemas.RAW.names)
    )
    stored = embedding.embed(
        items.filter(F.col("accords") == "SMALL"), _layers(spark, sf).embeddings.limit(0), ENCODER, "new", prefer="url"
    )
    return _show(embedding.embed(items, stored, ENCODER, "changed", prefer="url"))


def ingest_raw(spark, sf):
    return _ingested(spark, sf).layers.raw


def ingest_clean(spark, sf):
    clean = _ingested(spark, sf).layers.clean
    return clean.withColumns({c: F.col(c).cast("double") for c in ("rating", "rating_count")})


def ingest_embeddings(spark, sf):
    return _show(_ingested(spark, sf).layers.embeddings)


def remove_items(spark, sf):
    """Every PROMO and LARGE item leaves all layers."""
    gone = _items(spark, sf).filter(F.col("accords").rlike("promo|large")).select("id", "url")
    left = ingesting.remove(gone, _layers(spark, sf))
    named = [
        df.select(F.lit(name).alias("layer"), F.col(key).cast("string").alias("key"))
        for name, df, key in (("raw", left.raw, "url"), ("clean", left.clean, "id"), ("embeddings", left.embeddings, "id"))
    ]
    return named[0].unionByName(named[1]).unionByName(named[2])


def stored_jobs(spark, sf):
    """Clean, embed, ingest, embed again and compact, all over stored tables."""
    root = runtime.scratch_path(spark, "jobs")
    where = jobs.Store(f"{root}/raw", f"{root}/clean", f"{root}/embeddings")
    old = _records(spark, sf, F.when(F.col("p_size") > 25, "; base note is Musk").otherwise(""))
    old = stringify(old.filter(~F.col("main_accords")[1].contains("promo")), schemas.RAW.names)
    store.publish(old, where.raw)
    jobs.run_clean(spark, where)
    jobs.run_embed(spark, where, ENCODER, mode="new")
    jobs.run_ingest(spark, where, _incoming(spark, sf), ENCODER)
    jobs.run_embed(spark, where, ENCODER, mode="changed")
    store.compact(spark, where.embeddings, ["id"], files=8)
    return _show(store.read_current(spark, where.embeddings))


def ingest_stream(spark, sf):
    """The same records in two arrivals of files, each taken in by a run of its own; one batch is repeated."""
    before, root = _layers(spark, sf), runtime.scratch_path(spark, "arriving")
    where = jobs.Store(f"{root}/raw", f"{root}/clean", f"{root}/embeddings")
    for layer, table_of in ((before.raw, where.raw_table), (before.clean, where.clean_table), (before.embeddings, where.embeddings_table)):
        table_of.publish(layer)
    incoming = _incoming(spark, sf)
    early = F.pmod(F.xxhash64("url"), F.lit(2)) == 0
    for arrival in (early, ~early):
        incoming.filter(arrival).write.mode("append").parquet(f"{root}/in")
        arriving.run_arriving(
            spark, where, f"{root}/in", incoming.schema, ENCODER, f"{root}/checkpoint", f"{root}/reports"
        )
    arriving.ingest_batch(where, incoming.filter(early), 0, ENCODER, f"{root}/reports")
    return _show(where.embeddings_table.read(spark))


def find_and_recommend(spark, sf):
    """From a typed name to the items most like its best hit."""
    layers = _layers(spark, sf)
    items = changes.rows_in(layers.clean.withColumn("id", text.to_key("id")), layers.embeddings, "id")
    found = recommending.find_and_recommend(items, layers.embeddings, "Rod Hot", 10, columns=["name", "brand", "accords"])
    return found.withColumn("similarity", F.round("similarity", 6))


def tag_function(spark, sf):
    """The tag bag called from SQL."""
    sql.register_tag_function(spark)
    cleaning.clean_items(raw_items(spark, sf)).createOrReplaceTempView("tag_function_items")
    return spark.sql(
        """SELECT url, generate_perfume_string(accords, top_notes, mid_notes, base_notes) AS tags,
        generate_perfume_string(accords, NULL, '', mid_notes) AS fewer FROM tag_function_items"""
    )


def single_vs_bulk(spark, sf):
    """Fresh records through the clean job's own rules, against the stored layer."""
    single = cleaning.clean_items(stringify(_incoming(spark, sf), schemas.RAW.names))
    bulk = _items(spark, sf).select("url", F.col("perfume_string").alias("bulk_string"))
    return single.join(bulk, "url").select(
        "url", "perfume_string", (F.col("perfume_string") == F.col("bulk_string")).alias("same")
    )


QUERIES = {
    f.__name__: f
    for f in (
        encode_hash, embed_new, embed_changed, ingest, ingest_raw, ingest_clean, ingest_embeddings,
        pages_to_layers, manual_entry, embed_shared_ids,
        remove_items, single_vs_bulk, stored_jobs, ingest_stream, find_and_recommend, tag_function,
    )
}

def _records_sql(name: str, base: str) -> str:
    return f"""{name} AS (
  SELECT {ITEM_URL_SQL} AS url, {ITEM_TITLE_SQL} AS name, {ITEM_GENDER_SQL} AS gender,
    p_size || '.0' AS rating, p_size::VARCHAR AS rating_count, {ITEM_ACCORDS_SQL} AS main_accords,
    '[''' || replace(p_brand, '#', ' ') || ''']' AS perfumers, {item_prose_sql("1999", base)} AS description
  FROM part)"""


_LAYERS = f"""{_records_sql("older", "CASE WHEN p_size > 25 THEN '; base note is Musk' ELSE '' END")},
{clean_items_sql(source="older", name="all_items")},
items AS (SELECT * FROM all_items WHERE id IS NOT NULL),
clean AS (SELECT * FROM items WHERE accords NOT LIKE '%promo%'),
stored AS (SELECT id::BIGINT AS id, perfume_string FROM clean WHERE accords NOT LIKE '%standard%'),
{_records_sql("incoming", "''")},
{clean_items_sql(source="incoming", name="fresh_all")},
fresh AS (SELECT * FROM fresh_all WHERE id IS NOT NULL)"""



def _report_sql(fresh: str, missing: str) -> str:
    return f"""SELECT f.url, f.id, f.name, f.brand, f.perfume_string,
  CASE WHEN f.id IS NULL THEN 'rejected' WHEN c.id IS NULL THEN 'added' WHEN s.id IS NULL THEN 'unembedded'
    WHEN s.perfume_string = f.perfume_string THEN 'unchanged' ELSE 'updated' END AS status,
  CASE WHEN f.id IS NULL THEN 'no id in the address' WHEN f.perfume_string = '' THEN 'nothing to embed' END AS reason,
  {missing} AS missing_fields,
  f.id IS NOT NULL AND f.perfume_string <> '' AND s.perfume_string IS DISTINCT FROM f.perfume_string AS needs_embedding
FROM {fresh} f JOIN {fresh.removesuffix("_all")}_given g ON g.url = f.url
LEFT JOIN clean c ON c.id = f.id LEFT JOIN stored s ON s.id::VARCHAR = f.id"""



def _vectors(rows: str) -> str:
    return f"""result AS ({rows}),
{hash_vectors_sql("result", "id", "perfume_string", DIMS)}
SELECT result.id, perfume_string, embedding FROM result JOIN hashed_text ON key = result.id"""


_AFTER = """SELECT id::BIGINT AS id, perfume_string FROM fresh
UNION ALL SELECT id, perfume_string FROM stored WHERE id::VARCHAR NOT IN (SELECT id FROM fresh)"""

_KEPT = """id, name, brand, release_year, accords, top_notes, mid_notes, base_notes, perfumers, gender"""

SQL = {
    "stored_jobs": f"WITH {_LAYERS}, " + _vectors("SELECT id::BIGINT AS id, perfume_string FROM fresh"),
    "find_and_recommend": f"""WITH RECURSIVE {_LAYERS},
{scores_sql("SELECT DISTINCT name AS n, 'rod hot' AS t FROM clean")},
chosen AS (SELECT id::BIGINT AS id FROM clean JOIN scores ON n = name
  WHERE score > 70 AND id::BIGINT IN (SELECT id FROM stored)
  ORDER BY score DESC, release_year DESC NULLS LAST, id::BIGINT LIMIT 1),
{hash_vectors_sql("stored", "id", "perfume_string", DIMS)},
vecs AS (SELECT key, list(value::DOUBLE ORDER BY bucket) AS v FROM hashed GROUP BY key),
top AS (SELECT a.key AS id, round(list_cosine_similarity(a.v, b.v), 9) AS sim FROM vecs a, vecs b
  WHERE b.key = (SELECT id FROM chosen) AND a.key <> b.key ORDER BY sim DESC, a.key LIMIT 10)
SELECT top.id, round(sim, 6) AS similarity, name, brand, accords FROM top JOIN clean ON clean.id::BIGINT = top.id""",
    "tag_function": f"""WITH {RAW_ITEMS_SQL}, {clean_items_sql()}
SELECT url, perfume_string AS tags, {tag_bag_sql([("accords_", "accords"), ("base_notes_", "mid_notes")])} AS fewer
FROM clean_items""",
    "encode_hash": f"""WITH docs AS (SELECT doc_id, text FROM documents),
{hash_vectors_sql("docs", "doc_id", "text", DIMS)}
SELECT key AS doc_id, embedding FROM hashed_text""",
    "embed_new": f"WITH {_LAYERS}, " + _vectors("SELECT id::BIGINT AS id, perfume_string FROM items"),
    "embed_changed": f"WITH {_LAYERS}, " + _vectors(_AFTER),
    "ingest": f"""WITH {_LAYERS}, fresh_given AS (SELECT url, gender FROM incoming)
{_report_sql("fresh_all", "CASE WHEN g.gender IS NULL THEN 'gender' ELSE '' END")}""",
    "pages_to_layers": f"""WITH {_LAYERS}, {ITEM_PAGES_SQL},
paged AS (SELECT url, name, gender, rating, rating_count, '[''' || replace(main_accords, '|', ''', ''') || ''']' AS main_accords,
  '[''' || replace(perfumers, '|', ''', ''') || ''']' AS perfumers, description FROM found),
{clean_items_sql(source="paged", name="read_all")},
read_given AS (SELECT url, concat_ws(', ', CASE WHEN name = 'N/A' THEN 'name' END, CASE WHEN gender = 'N/A' THEN 'gender' END,
  CASE WHEN rating = 'N/A' THEN 'rating' END, CASE WHEN rating_count = 'N/A' THEN 'rating_count' END,
  CASE WHEN main_accords = '['''']' THEN 'main_accords' END, CASE WHEN perfumers = '['''']' THEN 'perfumers' END,
  CASE WHEN description = 'N/A' THEN 'description' END) AS missing_fields FROM paged)
{_report_sql("read_all", "g.missing_fields")}""",
    "manual_entry": f"""WITH {_LAYERS},
forms AS (SELECT {ITEM_URL_SQL} AS url, lower(p_type) || ', ' || lower(p_brand) AS accords,
  {item_prose_sql("2001", "''")} AS description FROM part)
SELECT f.url, i.name, 'men' AS gender, i.rating::VARCHAR AS rating, i.rating_count::VARCHAR AS rating_count,
  '[''' || replace(f.accords, ', ', ''', ''') || ''']' AS main_accords, i.perfumers, f.description,
  x.id, CASE WHEN x.id IS NOT NULL THEN f.accords END AS accords,
  CASE WHEN x.id IS NOT NULL THEN '2001' END AS release_year, c.perfumers AS perfumers_clean,
  CASE WHEN x.id IS NOT NULL THEN 'men' END AS clean_gender
FROM forms f LEFT JOIN items i ON i.url = f.url LEFT JOIN clean c ON c.url = f.url
LEFT JOIN fresh x ON x.url = f.url""",
    "embed_shared_ids": f"""WITH src AS (SELECT DISTINCT p_brand, p_size, p_type FROM part WHERE p_type <> 'PROMO'),
best AS (SELECT p_size::BIGINT AS id, 'accords_' || p_type AS perfume_string FROM (
  SELECT * FROM src QUALIFY row_number() OVER (PARTITION BY p_brand, p_size ORDER BY p_type) = 1)
  QUALIFY row_number() OVER (PARTITION BY p_size ORDER BY p_brand DESC) = 1),
{hash_vectors_sql("best", "id", "perfume_string", DIMS)}
SELECT id, perfume_string, embedding FROM best JOIN hashed_text ON key = id""",
    "ingest_raw": f"""WITH {_LAYERS},
old AS (SELECT url, name, gender, rating::VARCHAR AS rating, rating_count::VARCHAR AS rating_count,
  accords AS main_accords, perfumers, description FROM items)
SELECT * FROM old WHERE url NOT IN (SELECT url FROM incoming) UNION ALL SELECT * FROM incoming""",
    "ingest_clean": f"""WITH {_LAYERS}
SELECT {", ".join("f." + c for c in _KEPT.split(", "))}, c.rating_count::DOUBLE AS rating_count, c.rating::DOUBLE AS rating, f.description, f.url,
  f.perfume_string FROM fresh f LEFT JOIN clean c ON c.id = f.id
UNION ALL SELECT {_KEPT}, rating_count::DOUBLE, rating::DOUBLE, description, url, perfume_string
FROM clean WHERE id NOT IN (SELECT id FROM fresh)""",
    "ingest_embeddings": f"WITH {_LAYERS}, " + _vectors(_AFTER),
    "ingest_stream": f"WITH {_LAYERS}, " + _vectors(_AFTER),
    "remove_items": f"""WITH {_LAYERS},
left_over AS (SELECT * FROM items WHERE accords NOT LIKE '%promo%' AND accords NOT LIKE '%large%')
SELECT 'raw' AS layer, url AS key FROM left_over
UNION ALL SELECT 'clean', id FROM left_over
UNION ALL SELECT 'embeddings', id FROM left_over WHERE accords NOT LIKE '%standard%'""",
    "single_vs_bulk": f"""WITH {_LAYERS}
SELECT f.url, f.perfume_string, f.perfume_string = i.perfume_string AS same FROM fresh f JOIN items i ON i.url = f.url""",
}
