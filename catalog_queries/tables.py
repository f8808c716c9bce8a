"""Table access and the item tables derived from the driver's tables.

There are no scraped items among the driver's tables, so a raw layer of the
same shape is derived from them: one scraped copy of an item per line item,
one address per part.  Each derived table exists twice, as a DataFrame and as
the SQL of a CTE.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def item_url() -> Column:
    return F.concat(
        F.lit("https://www.example.com/perfume/"),
        F.translate("p_brand", "#", "-"),
        F.lit("/"),
        F.translate("p_name", " ", "-"),
        F.lit("-"),
        F.col("p_partkey").cast("string"),
        F.when(F.col("p_size") == 50, "").otherwise(".html"),
    )


def item_title() -> Column:
    return F.concat(
        "p_name",
        F.when(F.col("p_type") == "ECONOMY", " for women and men")
        .when(F.col("p_type") == "SMALL", " for women")
        .when(F.col("p_type") == "LARGE", " for men")
        .otherwise(""),
    )


def item_gender() -> Column:
    return F.when(F.col("p_type") == "MEDIUM", "for women").when(F.col("p_type") == "PROMO", "unisex")


def item_accords() -> Column:
    return F.array(F.split_part("p_name", F.lit(" "), F.lit(1)), F.concat(F.lower("p_type"), F.lit(" wood")))


def item_prose(year: Column, base: Column) -> Column:
    return F.concat(
        F.col("p_name"),
        F.lit(" was launched in "),
        year.cast("string"),
        F.lit(". Top notes are "),
        F.split_part("p_name", F.lit(" "), F.lit(1)),
        F.lit(" and "),
        F.initcap("p_type"),
        F.lit("; middle notes are white andes and "),
        F.split_part("p_name", F.lit(" "), F.lit(2)),
        base,
        F.lit("."),
    )


def raw_items(spark: SparkSession, sf: str) -> DataFrame:
    """The raw layer: every column text, several copies per address."""
    quantity = F.col("l_quantity").cast("int").cast("string")
    accords = F.concat(F.lit("['"), F.array_join(item_accords(), "', '"), F.lit("']"))
    lines = table(spark, sf, "lineitem")
    parts = table(spark, sf, "part")
    return lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).select(
        item_url().alias("url"),
        item_title().alias("name"),
        item_gender().alias("gender"),
        F.when(F.col("l_returnflag") == "A", "N/A")
        .otherwise(F.concat(F.col("l_linenumber").cast("string"), F.lit("."), quantity))
        .alias("rating"),
        F.when(
            F.col("l_linestatus") == "O",
            F.concat(quantity, F.lit(","), F.lpad((F.col("l_linenumber") * 37).cast("string"), 3, "0")),
        )
        .otherwise(quantity)
        .alias("rating_count"),
        accords.alias("main_accords"),
        F.concat(F.lit("['"), F.translate("p_brand", "#", " "), F.lit("']")).alias("perfumers"),
        item_prose(
            F.year("l_shipdate"), F.when(F.col("l_returnflag") == "R", "; base note is Musk").otherwise("")
        ).alias("description"),
    )


ITEM_URL_SQL = """'https://www.example.com/perfume/' || replace(p_brand, '#', '-') || '/' || replace(p_name, ' ', '-')
    || '-' || p_partkey || CASE WHEN p_size = 50 THEN '' ELSE '.html' END"""

ITEM_TITLE_SQL = """p_name || CASE p_type WHEN 'ECONOMY' THEN ' for women and men' WHEN 'SMALL' THEN ' for women'
    WHEN 'LARGE' THEN ' for men' ELSE '' END"""

ITEM_GENDER_SQL = "CASE p_type WHEN 'MEDIUM' THEN 'for women' WHEN 'PROMO' THEN 'unisex' END"

ITEM_ACCORDS_SQL = "'[''' || split_part(p_name, ' ', 1) || ''', ''' || lower(p_type) || ' wood'']'"


def item_prose_sql(year: str, base: str) -> str:
    return f"""p_name || ' was launched in ' || {year} || '. Top notes are ' || split_part(p_name, ' ', 1) || ' and '
    || upper(p_type[1]) || lower(p_type[2:]) || '; middle notes are white andes and ' || split_part(p_name, ' ', 2)
    || {base} || '.'"""


RAW_ITEMS_SQL = f"""raw_items AS (
  SELECT {ITEM_URL_SQL} AS url,
    {ITEM_TITLE_SQL} AS name,
    {ITEM_GENDER_SQL} AS gender,
    CASE WHEN l_returnflag = 'A' THEN 'N/A' ELSE l_linenumber || '.' || l_quantity::INT END AS rating,
    CASE WHEN l_linestatus = 'O' THEN l_quantity::INT || ',' || lpad((l_linenumber * 37)::VARCHAR, 3, '0')
      ELSE l_quantity::INT::VARCHAR END AS rating_count,
    {ITEM_ACCORDS_SQL} AS main_accords,
    '[''' || replace(p_brand, '#', ' ') || ''']' AS perfumers,
    {item_prose_sql("year(l_shipdate)", "CASE WHEN l_returnflag = 'R' THEN '; base note is Musk' ELSE '' END")} AS description
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def extracted_sql(source: str) -> str:
    """The item preset's field rules as a select list over ``source``."""

    def notes(tier: str) -> str:
        found = f"regexp_extract(description, '(?i){tier} note[s]? (is|are) ([^.;]*)', 2)"
        return f"nullif(lower(regexp_replace({found}, ' and\\b', ',', 'g')), '')"

    def ends(c: str) -> str:
        return (
            f"CASE WHEN {c} LIKE '%for women and men' THEN 'unisex' WHEN {c} LIKE '%for women' THEN 'women' "
            f"WHEN {c} LIKE '%for men' THEN 'men' END"
        )

    def entries(c: str) -> str:
        ends, between = r"""^\[?[''"]?|[''"]?\]?$""", r"""[''"],\s*[''"]"""
        inner = f"regexp_replace(regexp_replace({c}, '{ends}', '', 'g'), '{between}', ', ', 'g')"
        return f"nullif(nullif(nullif({inner}, ''), 'None'), 'N/A')"

    return f"""SELECT nullif(regexp_extract(url, '([a-zA-Z0-9]+)[.]html$', 1), '') AS id,
    nullif(replace(regexp_extract(url, '/perfume/[^/]+/([^/]+)-[0-9]+[.]html', 1), '-', ' '), '') AS name,
    nullif(replace(regexp_extract(url, '/perfume/([^/]+)/', 1), '-', ' '), '') AS brand,
    nullif(regexp_extract(description, 'was launched in ([0-9]{{4}})', 1), '') AS release_year,
    {entries("main_accords")} AS accords,
    {notes("top")} AS top_notes,
    {notes("middle")} AS mid_notes,
    {notes("base")} AS base_notes,
    {entries("perfumers")} AS perfumers,
    coalesce({ends("name")}, {ends("gender")}, CASE WHEN gender IN ('unisex', 'women', 'men') THEN gender END) AS gender,
    TRY_CAST(replace(rating_count, ',', '') AS INT) AS rating_count,
    TRY_CAST(rating AS DECIMAL(10,2)) AS rating,
    nullif(nullif(description, 'None'), 'N/A') AS description, url
  FROM {source}"""


def tag_bag_sql(fields) -> str:
    """``fields`` as (prefix, column) pairs."""
    parts = ", ".join(
        f"CASE WHEN {c} <> '' THEN array_to_string(list_transform(string_split({c}, ','), "
        f"lambda x: '{prefix}' || replace(trim(x), ' ', '_')), ' ') END"
        for prefix, c in fields
    )
    return f"trim(concat_ws(' ', {parts}))"


ITEM_TAGS_SQL = tag_bag_sql(
    [("accords_", "accords"), ("top_notes_", "top_notes"), ("mid_notes_", "mid_notes"), ("base_notes_", "base_notes")]
)


def clean_items_sql(
    most_rated: str = "TRY_CAST(replace(rating_count, ',', '') AS INT)",
    source: str = "raw_items",
    name: str = "clean_items",
) -> str:
    """CTEs ending in ``<name>``: the clean layer of ``source``."""
    return f"""{name}_best AS (
  SELECT * FROM {source}
  QUALIFY row_number() OVER (PARTITION BY url ORDER BY {most_rated} DESC NULLS LAST,
    TRY_CAST(rating AS DECIMAL(10,2)) DESC NULLS LAST, rating_count NULLS LAST, description NULLS LAST,
    main_accords NULLS LAST, perfumers NULLS LAST, name NULLS LAST, gender NULLS LAST) = 1),
{name}_found AS ({extracted_sql(f"{name}_best")}),
{name} AS (SELECT *, {ITEM_TAGS_SQL} AS perfume_string FROM {name}_found)"""


def hash_vectors_sql(source: str, key: str, text: str, dims: int, name: str = "hashed") -> str:
    """CTE ``<name>``(key, bucket 0..dims-1, value): the hashing encoder over ``source``."""
    return f"""{name}_words AS (
  SELECT {key} AS key, unnest(string_split_regex(lower({text}), '[\\t-\\r\\x1c-\\x1f\\x85\\pZ]+')) AS word FROM {source}),
{name}_spots AS (
  SELECT key, ('0x' || md5(word)[1:8])::BIGINT % {dims} AS bucket,
    CASE WHEN md5(word)[9] < '8' THEN 1 ELSE -1 END AS sign FROM {name}_words WHERE word <> ''),
{name}_sums AS (SELECT key, bucket, sum(sign)::DOUBLE AS value FROM {name}_spots GROUP BY ALL),
{name}_norms AS (SELECT key, sqrt(sum(value * value)) AS norm FROM {name}_sums GROUP BY key),
{name} AS (
  SELECT s.{key} AS key, d.bucket,
    CAST(coalesce(v.value, 0) / CASE WHEN coalesce(n.norm, 0) = 0 THEN 1 ELSE n.norm END AS FLOAT) AS value
  FROM {source} s CROSS JOIN range(0, {dims}) d(bucket)
  LEFT JOIN {name}_sums v ON v.key = s.{key} AND v.bucket = d.bucket
  LEFT JOIN {name}_norms n ON n.key = s.{key}),
{name}_text AS (
  SELECT key, string_agg(CAST(round(value::DOUBLE * 1000000) AS BIGINT), ',' ORDER BY bucket) AS embedding
  FROM {name} GROUP BY key)"""


def vector_text(vec: str) -> Column:
    """A vector in millionths, so that two engines print it alike."""
    millionths = F.transform(vec, lambda x: F.round(x.cast("double") * 1000000).cast("bigint").cast("string"))
    return F.array_join(millionths, ",")
