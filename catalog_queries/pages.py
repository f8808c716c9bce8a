"""HTML pages: field extraction, coverage and sentinels."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from catalog_engine import rules
from catalog_engine.functions import text
from catalog_engine.operators import html_fields as html
from catalog_engine.operators import quality
from catalog_engine.sources import pages as source_pages
from catalog_queries.tables import (
    ITEM_URL_SQL,
    ITEM_TITLE_SQL,
    item_gender,
    item_prose,
    item_prose_sql,
    item_title,
    item_url,
    table,
)

PAGE_RULES = (
    html.HtmlRule("title", (html.Find("title"),)),
    html.HtmlRule("heading", (html.Find("article"), html.Find("h1")), join=" "),
    html.HtmlRule("lang", (html.Find("html"),), attr="lang"),
    html.HtmlRule("links", (html.Find("nav"), html.Find("a", {"href": re.compile("^/.+")})), attr="href", many=True),
    html.HtmlRule("advert", (html.Find("nav"), html.NextSibling("div"))),
    html.HtmlRule("body", (html.Find("article"), html.Find("p")), join=" "),
    html.HtmlRule("footer", (html.Find("footer"),)),
    html.HtmlRule("rating", (html.Find(attrs={"itemprop": "ratingValue"}),)),
)


def html_fields(spark, sf):
    found = html.extract_html_fields(table(spark, sf, "pages").select("page_id", "html"), "html", PAGE_RULES)
    return found.select(
        "page_id", "title", "heading", "lang", F.array_join("links", " ").alias("links"),
        F.size("links").alias("n_links"), "advert", "footer", "rating",
        F.regexp_replace("body", r"\s+", "").alias("body"),
    )


def item_page_table(spark, sf):
    """A page per part, in the markup of an item page; small parts have a sparse one."""

    def tagged(before: str, c, after: str):
        return F.concat(F.lit(before), c, F.lit(after))

    first = F.split_part("p_name", F.lit(" "), F.lit(1))
    head = tagged('<html><body><h1 class="wide text-center">\n  ', item_title(), "</h1>")
    rating = tagged('<p>Rated&nbsp;<span itemprop="ratingValue">', F.col("p_size").cast("string"), ".5</span>")
    count = tagged(' by <span itemprop="ratingCount" content="', F.col("p_partkey").cast("string"), '">9,9</span></p>')
    accords = F.concat(
        tagged('<h6>Main accords</h6><div class="flex"><div><span class="truncate">', F.upper(first), "</span></div>"),
        tagged('<div><span class="truncate"> ', F.col("p_type"), " Wood</span></div></div>"),
    )
    prose = item_prose(F.lit(1999), F.lit(""))
    about = tagged('<div itemprop="description"><p><b>', first, "</b> and\n   more: ")
    about = F.concat(about, tagged("", prose, "</p><div><p>Something else</p></div></div>"))
    makers = F.concat(
        *[tagged('<a href="/noses/x.html"><span>', F.translate("p_brand", "#", " "), "</span></a>")] * 2,
        tagged('<a href="/noses/y.html">', F.col("p_type"), '</a><a href="/noses/">All</a>'),
    )
    full = F.concat(head, rating, count, accords, about, makers, F.lit("</body></html>"))
    sparse = F.concat(head, F.lit('<a href="/noses/">All</a></body></html>'))
    page = F.when(F.col("p_size") < 10, sparse).otherwise(full)
    return table(spark, sf, "part").select(item_url().alias("url"), page.alias("html"))


def item_pages(spark, sf):
    found = html.item_pages_to_raw(item_page_table(spark, sf))
    return found.withColumns({c: F.array_join(c, "|") for c in ("main_accords", "perfumers")})


ITEM_FIELDS = ["name", "gender", "rating", "rating_count", "main_accords", "perfumers", "description"]


def field_coverage(spark, sf):
    return quality.field_coverage(html.item_pages_to_raw(item_page_table(spark, sf)), ITEM_FIELDS)


def sentinel_fields(spark, sf):
    columns = ["name", "gender", "rating", "rating_count", "description"]
    found = quality.sentinel_fields(html.item_pages_to_raw(item_page_table(spark, sf)), columns)
    return found.select("url", F.array_join("missing_fields", ", ").alias("missing_fields"))


def legacy_item_pages(spark, sf):
    """The older layout: address in a meta tag, category from the prose."""
    part = table(spark, sf, "part")
    page = F.concat(
        F.lit('<html><head><meta property="og:url" content="'), item_url(), F.lit('"/></head><body>'),
        F.lit('<div class="cell accord-box"> '), F.col("p_type"), F.lit("</div>"),
        F.lit('<div class="cell accord-box">'), F.col("p_brand"), F.lit(" </div>"),
        F.lit('<div class="cell small-12" itemprop="description">\n'), item_title(), F.lit("! </div>"),
        F.lit('<span itemprop="ratingValue">'), F.col("p_size").cast("string"), F.lit("</span></body></html>"),
    )
    found = html.extract_html_fields(part.select("p_partkey", page.alias("html")), "html", html.ITEM_PAGE_LEGACY)
    return found.select(
        "p_partkey", "url", "rating", "rating_count", F.array_join("main_accords", "|").alias("main_accords"),
        "description", text.suffix_category("description", rules.CATEGORY_SUFFIXES, "contains").alias("gender"),
    )


def legacy_records(spark, sf):
    """Whole records of one brand's pages of the older layout, and what is left of all others."""
    part = table(spark, sf, "part")
    prose = F.concat(F.lit("\n<b>"), F.col("p_name"), F.lit("</b> is a choice "), F.upper(item_gender()), F.lit(" &amp; more. "))
    about = F.when(F.col("p_size") == 7, "").otherwise(
        F.concat(F.lit('<div class="cell small-12" itemprop="description">'), F.coalesce(prose, "p_name"), F.lit("</div>"))
    )
    count = F.when(F.col("p_size") > 20, F.concat(F.lit('<span itemprop="ratingCount">'), "p_partkey", F.lit("</span>")))
    page = F.concat(
        F.lit('<html><head><meta property="og:url" content="'), item_url(), F.lit('"/></head><body>'),
        F.lit('<div class="cell accord-box"> '), F.col("p_type"), F.lit("</div>"), about,
        F.lit('<span itemprop="ratingValue">'), F.col("p_size").cast("string"), F.lit("</span>"),
        F.coalesce(count, F.lit("")), F.lit("</body></html>"),
    )
    found = html.legacy_pages_to_raw(part.select(page.alias("html")), "Brand-1")
    return found.withColumns({c: F.array_join(c, "|") for c in ("main_accords", "perfumers")})


def page_bytes(spark, sf):
    """All pages as bytes of four encodings, read as text again."""
    page = table(spark, sf, "pages").select("page_id", "html")
    turn = F.pmod("page_id", F.lit(4))
    # Where a page has letters that an encoding lacks, it stays in UTF-8.
    narrow = F.concat(F.lit('<meta charset="iso-8859-1">'), "html")
    fits = ~F.col("html").rlike(r"[^\x00-\x7F\xA0-\xFF]")
    content = (
        F.when((turn == 0) & fits, F.encode(narrow, "ISO-8859-1"))
        .when(turn == 1, F.encode("html", "UTF-16"))
        .when(turn == 2, F.concat(F.lit(b"\xef\xbb\xbf"), F.encode("html", "UTF-8")))
        .otherwise(F.encode("html", "UTF-8"))
    )
    read = source_pages.decode_pages(page.select("page_id", content.alias("content")))
    return read.select("page_id", F.regexp_replace("html", '^<meta charset="iso-8859-1">', "").alias("html"))


QUERIES = {
    f.__name__: f
    for f in (html_fields, item_pages, field_coverage, sentinel_fields, legacy_item_pages, legacy_records, page_bytes)
}


def _plain(c: str) -> str:
    out = f"regexp_replace({c}, '<[^>]*>', '', 'g')"
    for entity, char in (("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&amp;?", "&")):
        out = f"regexp_replace({out}, '{entity}', '{char}', 'g')"
    return out


ITEM_PAGES_SQL = f"""found AS (
  SELECT {ITEM_URL_SQL} AS url, p_name AS name,
    coalesce('for ' || CASE p_type WHEN 'ECONOMY' THEN 'women and men' WHEN 'SMALL' THEN 'women'
      WHEN 'LARGE' THEN 'men' END, 'N/A') AS gender,
    CASE WHEN p_size < 10 THEN 'N/A' ELSE p_size || '.5' END AS rating,
    CASE WHEN p_size < 10 THEN 'N/A' ELSE p_partkey::VARCHAR END AS rating_count,
    CASE WHEN p_size < 10 THEN '' ELSE split_part(p_name, ' ', 1) || '|' || lower(p_type) || ' wood' END AS main_accords,
    CASE WHEN p_size < 10 THEN '' ELSE replace(p_brand, '#', ' ') || '|' || p_type END AS perfumers,
    CASE WHEN p_size < 10 THEN 'N/A' ELSE split_part(p_name, ' ', 1) || ' and more: '
      || {item_prose_sql("1999", "''")} END AS description
  FROM part)"""

SQL = {
    "html_fields": f"""SELECT page_id, trim({_plain("regexp_extract(html, '<title>(.*?)</title>', 1)")}) AS title,
  trim({_plain("regexp_extract(html, '<h1>(.*?)</h1>', 1)")}) AS heading,
  regexp_extract(html, '<html lang="([a-z]+)"', 1) AS lang,
  array_to_string(regexp_extract_all(html, '<a href="([^"]*)"', 1), ' ') AS links,
  CAST(len(regexp_extract_all(html, '<a href="')) AS INT) AS n_links,
  trim({_plain("regexp_extract(html, '(?s)<div class=.ad.>(.*?)</div>', 1)")}) AS advert,
  trim({_plain("regexp_extract(html, '(?s)<footer>(.*?)</footer>', 1)")}) AS footer,
  CAST(NULL AS VARCHAR) AS rating,
  regexp_replace({_plain("regexp_extract(html, '(?s)</h1>(.*)</article>', 1)")}, '\\s+', '', 'g') AS body
FROM pages""",
    "item_pages": f"WITH {ITEM_PAGES_SQL} SELECT * FROM found",
    "field_coverage": f"WITH {ITEM_PAGES_SQL}, c AS ("
    + " UNION ALL ".join(
        f"SELECT '{f}' AS field, count(*) FILTER ({f} NOT IN ('N/A', '')) AS passing, count(*) AS total FROM found"
        for f in ITEM_FIELDS
    )
    + """)
SELECT field, passing, total,
  CASE WHEN passing = total THEN 'OK' WHEN passing = 0 THEN 'BROKEN' ELSE 'PARTIAL' END AS flag FROM c""",
    "sentinel_fields": f"""WITH {ITEM_PAGES_SQL}
SELECT url, concat_ws(', ', CASE WHEN name = 'N/A' THEN 'name' END, CASE WHEN gender = 'N/A' THEN 'gender' END,
  CASE WHEN rating = 'N/A' THEN 'rating' END, CASE WHEN rating_count = 'N/A' THEN 'rating_count' END,
  CASE WHEN description = 'N/A' THEN 'description' END) AS missing_fields FROM found""",
    "page_bytes": "SELECT page_id, html FROM pages",
    "legacy_records": f"""SELECT {ITEM_URL_SQL} AS url,
  CASE WHEN p_brand = 'Brand#1' THEN p_name ELSE 'N/A' END AS name,
  CASE WHEN p_size <> 7 AND p_type = 'MEDIUM' THEN 'for women' ELSE 'N/A' END AS gender,
  p_size::VARCHAR AS rating, CASE WHEN p_size > 20 THEN p_partkey::VARCHAR ELSE 'N/A' END AS rating_count,
  p_type AS main_accords, '' AS perfumers,
  CASE WHEN p_size = 7 THEN 'N/A'
    ELSE p_name || CASE p_type WHEN 'MEDIUM' THEN ' is a choice FOR WOMEN & more.' WHEN 'PROMO' THEN ' is a choice UNISEX & more.' ELSE '' END
  END AS description,
  CASE WHEN p_brand = 'Brand#1' THEN p_partkey::VARCHAR END AS id, CASE WHEN p_brand = 'Brand#1' THEN 'Brand 1' END AS brand
FROM part""",
    "legacy_item_pages": f"""SELECT p_partkey, {ITEM_URL_SQL} AS url, p_size::VARCHAR AS rating,
  CAST(NULL AS VARCHAR) AS rating_count, p_type || '|' || p_brand AS main_accords,
  {ITEM_TITLE_SQL} || '!' AS description,
  CASE p_type WHEN 'ECONOMY' THEN 'unisex' WHEN 'SMALL' THEN 'women' WHEN 'LARGE' THEN 'men' END AS gender
FROM part""",
}
