"""Field extraction, tolerant casts, de-duplication, tag bags and the clean job."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog_engine import rules
from catalog_engine import schema as schemas
from catalog_engine.functions import text
from catalog_engine.operators import quality
from catalog_engine.operators.dedupe import dedupe_best
from catalog_engine.operators.extract import extract_fields, stringify
from catalog_engine.plans import clean as cleaning
from catalog_engine.rules import FieldRule
from catalog_queries.tables import (
    ITEM_ACCORDS_SQL,
    ITEM_URL_SQL,
    RAW_ITEMS_SQL,
    clean_items_sql,
    item_accords,
    item_url,
    raw_items,
    table,
    tag_bag_sql,
)

HOST = r"^https?://([^/]+)/"
LANG = r"^https?://[^/]+/([a-z]+)/"
NUMBER = r"/([0-9]+)([./?#]|$)"
TITLE = r"<title>([^<]*)</title>"
LICENSE = r"under the ([A-Za-z ]+License)"
VERSION = r"version ([0-9]+)"
BRAND_PAGE = r"(Brand-17)/(.*?)-([0-9]+)"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"

URL_RULES = (
    FieldRule("host", "url", HOST),
    FieldRule("site", "url", HOST, post=lambda c: F.translate(c, ".", " ")),
    FieldRule("lang", "url", LANG),
    FieldRule("number", "url", NUMBER),
    FieldRule("id", "url", rules.URL_ID_PATTERN),
)

PROSE_RULES = (
    FieldRule("license", "text", LICENSE),
    FieldRule("version", "text", r"(?i)" + VERSION),
    FieldRule("email", "text", EMAIL, 0, F.lower),
)

PART_CATEGORIES = (("hot ring", "heated"), ("ring", "round"), ("plate", "flat"), ("rod", "long"))


def url_fields(spark, sf):
    return extract_fields(table(spark, sf, "pages"), URL_RULES, ["page_id"])


def one_brand_fields(spark, sf):
    """The older address form; other brands' addresses give NULL."""
    part = table(spark, sf, "part").select("p_partkey", item_url().alias("url"))
    return extract_fields(part, rules.one_brand_fields("Brand-17"), ["p_partkey"])


def prose_fields(spark, sf):
    return extract_fields(table(spark, sf, "documents"), PROSE_RULES, ["doc_id"])


def list_text_clean(spark, sf):
    items = F.concat(F.lit("['"), F.array_join(item_accords(), "', '"), F.lit("']"))
    lists = table(spark, sf, "part").select("p_partkey", items.alias("list_text"))
    parsed = text.list_text_to_array("list_text")
    return lists.select(
        "p_partkey",
        text.list_text_to_csv("list_text").alias("as_csv"),
        F.size(parsed).alias("entries"),
        F.element_at(parsed, -1).alias("last_entry"),
    )


def pasted_lines(spark, sf):
    lines = text.lines_to_array("text")
    return table(spark, sf, "documents").select(
        "doc_id", F.size(lines).alias("lines"), F.try_element_at(lines, F.lit(1)).alias("first_line")
    )


def suffix_category(spark, sf):
    return table(spark, sf, "part").select(
        "p_partkey",
        text.suffix_category("p_name", PART_CATEGORIES).alias("by_suffix"),
        text.suffix_category("p_name", (("RED", "warm"), ("Blue", "cold")), "contains").alias("by_content"),
    )


def safe_cast(spark, sf):
    return table(spark, sf, "events").select(
        "event_id",
        text.to_int(F.regexp_extract("props", r'"k": ([^}]*)', 1)).alias("k"),
        text.to_int("event_type").cast("double").alias("no_number"),
        text.to_key(F.concat(F.col("user_id").cast("string"), F.lit(""))).alias("key"),
        text.to_decimal(F.regexp_extract("props", r"([0-9]+)", 1)).cast("double").alias("amount"),
    )


def missing_default(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text").filter(
        F.col("text").isNotNull() & (F.col("text") != "")
    )
    labels = table(spark, sf, "labels")
    return docs.join(labels, "doc_id", "left").select(
        "doc_id", text.or_label(F.col("quality").cast("string"), rules.MISSING_LABEL).alias("quality")
    )


def best_pages(spark, sf):
    titled = table(spark, sf, "pages").select(
        "page_id", text.extract("html", TITLE).alias("title"), F.length("html").alias("size")
    )
    return dedupe_best(titled, ["title"], [F.desc("size"), F.asc("page_id")])


def tag_bag(spark, sf):
    part = table(spark, sf, "part").select(
        "p_partkey", F.translate("p_name", " ", ",").alias("words"), "p_type", "p_brand"
    )
    return part.select(
        "p_partkey", text.tag_bag([("word_", "words"), ("kind_", "p_type"), ("made_by_", "p_brand")]).alias("tags")
    )


def page_spec():
    return cleaning.CleanSpec(
        fields=(
            FieldRule("host", "url", HOST, post=lambda c: F.translate(c, ".", " ")),
            FieldRule("lang", "url", LANG),
            FieldRule("title", "html", TITLE),
        ),
        extra=(
            text.suffix_category("url", ((".html", "file"), ("/", "folder"), ("#top", "anchor"))).alias("kind"),
            text.to_int(F.regexp_extract("url", NUMBER, 1)).alias("number"),
            F.length("html").alias("size"),
            F.col("page_id"),
        ),
        keys=("title",),
        order=(F.desc("size"), F.asc("page_id")),
        best_first=False,
        tags=(("host_", "host"), ("lang_", "lang"), ("kind_", "kind")),
        tag_column="tags",
        drop=("size",),
    )


def clean_job(spark, sf):
    return cleaning.clean(table(spark, sf, "pages"), page_spec())


def _portable(items):
    return items.withColumn("rating", F.col("rating").cast("double"))


def clean_items(spark, sf):
    return _portable(cleaning.clean_items(raw_items(spark, sf)))


def clean_marked_items(spark, sf):
    """Records as older runs stored them: marks for missing values, quotes and commas inside entries."""
    accords = (
        F.when(F.col("p_type") == "ECONOMY", "None")
        .when(F.col("p_type") == "SMALL", "N/A")
        .when(F.col("p_type") == "LARGE", "[]")
        .when(F.col("p_type") == "PROMO", F.concat(F.lit("""["lily's", '"""), F.lower("p_brand"), F.lit("']")))
        .otherwise(F.concat(F.lit("['warm, dry', \""), "p_name", F.lit("'s\"]")))
    )
    records = table(spark, sf, "part").select(
        item_url().alias("url"),
        accords.alias("main_accords"),
        F.when(F.col("p_size") < 10, "N/A").when(F.col("p_size") < 20, "None").otherwise(F.lit("['A', 'B']")).alias("perfumers"),
        F.when(F.col("p_size") > 40, "N/A").otherwise(F.col("p_name")).alias("description"),
        F.lit("N/A").alias("gender"),
        F.lit("N/A").alias("rating"),
    )
    return _portable(cleaning.clean_items(stringify(records, schemas.RAW.names)))


def clean_items_string_order(spark, sf):
    return _portable(cleaning.clean_items(raw_items(spark, sf), order_as="string"))


def vocabulary(spark, sf):
    items = cleaning.clean_items(raw_items(spark, sf))
    return quality.vocabulary(items, ["accords", "top_notes", "mid_notes", "base_notes"])


def stringified(spark, sf):
    columns = ["s_suppkey", "s_name", "s_nationkey", "s_acctbal", "s_phone"]
    return stringify(table(spark, sf, "supplier"), columns)


def alias_normalise(spark, sf):
    aliases = (("red widget", "rw"), ("red", "rd"), ("small", "s$"), ("rd ring", "rr"), ("old", "o"))
    return table(spark, sf, "part").select(
        "p_partkey", text.normalize_aliases(F.initcap("p_name"), aliases).alias("normal")
    )


QUERIES = {
    f.__name__: f
    for f in (
        url_fields, one_brand_fields, prose_fields, list_text_clean, pasted_lines, suffix_category, safe_cast,
        missing_default, tag_bag, clean_job, clean_items, clean_marked_items, clean_items_string_order, vocabulary,
        stringified, alias_normalise,
    )
} | {"dedupe_best": best_pages}


def _got(c: str, pattern: str, group: int = 1) -> str:
    return f"nullif(regexp_extract({c}, '{pattern}', {group}), '')"


SQL = {
    "url_fields": f"""SELECT {_got("url", HOST)} AS host, replace({_got("url", HOST)}, '.', ' ') AS site,
  {_got("url", LANG)} AS lang, {_got("url", NUMBER)} AS number, {_got("url", rules.URL_ID_PATTERN)} AS id,
  page_id FROM pages""",
    "one_brand_fields": f"""WITH t AS (SELECT p_partkey, {ITEM_URL_SQL} AS url FROM part)
SELECT p_partkey, replace({_got("url", BRAND_PAGE, 2)}, '-', ' ') AS name,
  replace({_got("url", BRAND_PAGE, 1)}, '-', ' ') AS brand, {_got("url", BRAND_PAGE, 3)} AS id FROM t""",
    "prose_fields": f"""SELECT {_got("text", LICENSE)} AS license, {_got("text", "(?i)" + VERSION)} AS version,
  lower({_got("text", EMAIL, 0)}) AS email, doc_id FROM documents""",
    "list_text_clean": f"""WITH t AS (SELECT p_partkey, {ITEM_ACCORDS_SQL} AS list_text FROM part),
c AS (SELECT p_partkey, translate(list_text, '[]''', '') AS as_csv FROM t)
SELECT p_partkey, as_csv, CAST(len(string_split(as_csv, ',')) AS INT) AS entries,
  trim(string_split(as_csv, ',')[-1]) AS last_entry FROM c""",
    "pasted_lines": r"""WITH t AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)),
  lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS l FROM documents)
SELECT doc_id, CAST(len(l) AS INT) AS lines, l[1] AS first_line FROM t""",
    "suffix_category": """SELECT p_partkey,
  CASE WHEN p_name LIKE '%hot ring' THEN 'heated' WHEN p_name LIKE '%ring' THEN 'round'
    WHEN p_name LIKE '%plate' THEN 'flat' WHEN p_name LIKE '%rod' THEN 'long' END AS by_suffix,
  CASE WHEN p_name ILIKE '%red%' THEN 'warm' WHEN p_name ILIKE '%blue%' THEN 'cold' END AS by_content
FROM part""",
    "safe_cast": """SELECT event_id, TRY_CAST(replace(regexp_extract(props, '"k": ([^}]*)', 1), ',', '') AS INT) AS k,
  TRY_CAST(event_type AS INT)::DOUBLE AS no_number, TRY_CAST(user_id::VARCHAR AS BIGINT) AS key,
  TRY_CAST(regexp_extract(props, '([0-9]+)', 1) AS DECIMAL(10,2))::DOUBLE AS amount FROM events""",
    "missing_default": """SELECT d.doc_id, coalesce(nullif(quality::VARCHAR, ''), '—') AS quality
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE text IS NOT NULL AND text <> ''""",
    "dedupe_best": f"""WITH t AS (SELECT page_id, {_got("html", TITLE)} AS title,
  CAST(length(html) AS INT) AS size FROM pages)
SELECT page_id, title, size FROM t
QUALIFY row_number() OVER (PARTITION BY title ORDER BY size DESC, page_id) = 1""",
    "tag_bag": "WITH t AS (SELECT p_partkey, replace(p_name, ' ', ',') AS words, p_type, p_brand FROM part)\n"
    f"SELECT p_partkey, {tag_bag_sql([('word_', 'words'), ('kind_', 'p_type'), ('made_by_', 'p_brand')])} AS tags FROM t",
    "clean_job": f"""WITH t AS (
  SELECT replace({_got("url", HOST)}, '.', ' ') AS host, {_got("url", LANG)} AS lang, {_got("html", TITLE)} AS title,
    CASE WHEN url LIKE '%.html' THEN 'file' WHEN url LIKE '%/' THEN 'folder' WHEN url LIKE '%#top' THEN 'anchor' END AS kind,
    TRY_CAST(regexp_extract(url, '{NUMBER}', 1) AS INT) AS number, length(html) AS size, page_id
  FROM pages QUALIFY row_number() OVER (PARTITION BY title ORDER BY size DESC, page_id) = 1)
SELECT host, lang, title, kind, number, page_id,
  {tag_bag_sql([("host_", "host"), ("lang_", "lang"), ("kind_", "kind")])} AS tags FROM t""",
    "clean_items": f"""WITH {RAW_ITEMS_SQL}, {clean_items_sql()}
SELECT * REPLACE (rating::DOUBLE AS rating) FROM clean_items""",
    "clean_marked_items": f"""WITH marked AS (SELECT {ITEM_URL_SQL} AS url, CASE p_type WHEN 'ECONOMY' THEN 'None'
    WHEN 'SMALL' THEN 'N/A' WHEN 'LARGE' THEN '[]' WHEN 'PROMO' THEN '["lily''s", ''' || lower(p_brand) || ''']'
    ELSE '[''warm, dry'', "' || p_name || '''s"]' END AS main_accords,
  CASE WHEN p_size < 10 THEN 'N/A' WHEN p_size < 20 THEN 'None' ELSE '[''A'', ''B'']' END AS perfumers,
  CASE WHEN p_size > 40 THEN 'N/A' ELSE p_name END AS description, 'N/A' AS gender, 'N/A' AS rating,
  NULL::VARCHAR AS name, NULL::VARCHAR AS rating_count FROM part),
{clean_items_sql(source="marked")}
SELECT * REPLACE (rating::DOUBLE AS rating) FROM clean_items""",
    "clean_items_string_order": f"""WITH {RAW_ITEMS_SQL}, {clean_items_sql("rating_count")}
SELECT * REPLACE (rating::DOUBLE AS rating) FROM clean_items""",
    "vocabulary": f"""WITH {RAW_ITEMS_SQL}, {clean_items_sql()},
e AS (
  SELECT 'accords' AS field, unnest(string_split(accords, ',')) AS term FROM clean_items UNION ALL
  SELECT 'top_notes', unnest(string_split(top_notes, ',')) FROM clean_items UNION ALL
  SELECT 'mid_notes', unnest(string_split(mid_notes, ',')) FROM clean_items UNION ALL
  SELECT 'base_notes', unnest(string_split(base_notes, ',')) FROM clean_items)
SELECT DISTINCT field, trim(term) AS term FROM e WHERE trim(term) <> ''""",
    "stringified": """SELECT s_suppkey::VARCHAR AS s_suppkey, s_name, s_nationkey::VARCHAR AS s_nationkey,
  s_acctbal::VARCHAR AS s_acctbal, CAST(NULL AS VARCHAR) AS s_phone FROM supplier""",
    "alias_normalise": r"""SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
  lower(p_name), '\bred widget\b', 'rw', 'g'), '\bred\b', 'rd', 'g'), '\bsmall\b', 's$', 'g'),
  '\brd ring\b', 'rr', 'g'), '\bold\b', 'o', 'g') AS normal FROM part""",
}
