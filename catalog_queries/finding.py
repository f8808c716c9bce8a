"""Fuzzy name search."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog_engine.functions import fuzzy, text
from catalog_engine.operators import search as S
from catalog_queries.tables import table

TIER_TERMS = ("red rod", "rod", "large r", "ing")
TERM = "red rod"


def fuzzy_tiers(spark, sf):
    norm = text.normalize_aliases(F.initcap("p_name"), ())
    return table(spark, sf, "part").select(
        "p_partkey",
        *[fuzzy.tier_score(norm, t).alias(f"score_{i}") for i, t in enumerate(TIER_TERMS)],
    )


def fuzzy_full(spark, sf):
    score = fuzzy.fuzzy_score(F.initcap("p_name"), TERM)
    return table(spark, sf, "part").select("p_partkey", F.round(score, 6).alias("score"))


def search(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", "p_name", "p_brand", "p_size")
    found = S.search(part, " Rod Redd ", "p_name", "p_partkey", threshold=40, limit=200, tie_cols=["p_size"])
    return found.withColumn("score", F.round("score", 6))


def _typed_terms(spark, sf):
    """What users might type: every name with its words swapped, and every last word."""
    words = [F.split_part("p_name", F.lit(" "), F.lit(i)) for i in (1, 2)]
    part = table(spark, sf, "part")
    swapped = part.select(F.concat_ws(" ", words[1], words[0]).alias("term"))
    return swapped.union(part.select(words[1])).union(part.select(F.lit("  "))).distinct()


def search_terms(spark, sf):
    part = table(spark, sf, "part")
    found = S.search_terms(
        part, _typed_terms(spark, sf), "term", "p_name", "p_partkey", limit=3, tie_cols=["p_size"], columns=["p_name"]
    )
    return found.withColumn("score", F.round("score", 6))


QUERIES = {f.__name__: f for f in (fuzzy_tiers, fuzzy_full, search, search_terms)}


def _tiers(n: str, t: str) -> str:
    """CASE branches of the four exact tiers; ``t`` is a word or holds a space."""
    return (
        f"WHEN {n} = {t} THEN 100.0 "
        f"WHEN list_contains(regexp_extract_all({n}, '[a-z0-9_]+'), {t}) THEN 95.0 "
        f"WHEN starts_with({n}, {t}) THEN 90.0 WHEN contains({n}, {t}) THEN 85.0"
    )


def scores_sql(pairs: str) -> str:
    """CTE ``scores``(n, t, score) for the distinct (n, t) pairs of a query."""
    return f"""pairs AS ({pairs}),
words AS (SELECT n, t, list_sort(string_split(n, ' ')) AS nw, list_sort(string_split(t, ' ')) AS tw FROM pairs),
sets AS (
  SELECT n, t, array_to_string(nw, ' ') AS ns, array_to_string(tw, ' ') AS ts,
    list_sort(list_distinct(list_intersect(nw, tw))) AS shared,
    array_to_string(list_sort(list_distinct(list_filter(nw, lambda x: NOT list_contains(tw, x)))), ' ') AS nd,
    array_to_string(list_sort(list_distinct(list_filter(tw, lambda x: NOT list_contains(nw, x)))), ' ') AS td
  FROM words),
todo AS (SELECT n AS a, t AS b FROM sets UNION SELECT ns, ts FROM sets UNION SELECT nd, td FROM sets),
step(a, b, i, prev) AS (
  SELECT a, b, 0, list_transform(range(0, length(b) + 1), lambda x: 0) FROM todo
  UNION ALL
  SELECT a, b, i + 1, cur FROM (SELECT a, b, i,
    (SELECT list(m ORDER BY j) FROM (
       SELECT j, max(g) OVER (ORDER BY j ROWS UNBOUNDED PRECEDING) AS m FROM (
         SELECT j, CASE WHEN j = 0 THEN 0 WHEN substr(b, j, 1) = substr(a, i + 1, 1) THEN prev[j] + 1 ELSE prev[j + 1] END AS g
         FROM unnest(range(0, length(b) + 1)) u(j)))) AS cur
    FROM step WHERE i < length(a))),
lcs AS (SELECT a, b, prev[-1] AS l FROM step WHERE i = length(a)),
parts AS (
  SELECT n, t, 200.0 * l1.l / (length(n) + length(t)) AS ratio, 200.0 * l2.l / (length(ns) + length(ts)) AS sorted,
    length(array_to_string(shared, ' ')) AS s, length(nd) AS ln, length(td) AS lt, l3.l AS ld
  FROM sets JOIN lcs l1 ON l1.a = n AND l1.b = t JOIN lcs l2 ON l2.a = ns AND l2.b = ts
  JOIN lcs l3 ON l3.a = nd AND l3.b = td),
scores AS (
  SELECT n, t, CASE {_tiers("n", "t")} ELSE least(80.0, round(0.4 * ratio + 0.2 * sorted + 0.4 * CASE
      WHEN s = 0 THEN 200.0 * ld / (ln + lt)
      WHEN ln = 0 OR lt = 0 THEN 100.0
      ELSE greatest(200.0 * (s + 1 + ld) / (2 * (s + 1) + ln + lt), 200.0 * s / (2 * s + 1 + ln), 200.0 * s / (2 * s + 1 + lt))
    END, 9)) END::DOUBLE AS score FROM parts)"""


SQL = {
    "fuzzy_tiers": "SELECT p_partkey, "
    + ", ".join(f"CASE {_tiers('p_name', repr(t))} END::DOUBLE AS score_{i}" for i, t in enumerate(TIER_TERMS))
    + " FROM part",
    "fuzzy_full": f"""WITH RECURSIVE {scores_sql(f"SELECT DISTINCT p_name AS n, '{TERM}' AS t FROM part")}
SELECT p_partkey, round(score, 6) AS score FROM part JOIN scores ON n = p_name""",
    "search": f"""WITH RECURSIVE {scores_sql("SELECT DISTINCT p_name AS n, 'rod redd' AS t FROM part")}
SELECT p_partkey, p_name, p_brand, p_size, round(score, 6) AS score FROM part JOIN scores ON n = p_name
WHERE score > 40 ORDER BY score DESC, p_size DESC, p_partkey LIMIT 200""",
    "search_terms": f"""WITH RECURSIVE terms AS (
  SELECT split_part(p_name, ' ', 2) || ' ' || split_part(p_name, ' ', 1) AS term FROM part
  UNION SELECT split_part(p_name, ' ', 2) FROM part),
{scores_sql("SELECT DISTINCT p_name AS n, term AS t FROM part, terms")}
SELECT t AS term, p_partkey, p_size, p_name, round(score, 6) AS score,
  CAST(row_number() OVER (PARTITION BY t ORDER BY score DESC, p_size DESC, p_partkey) AS INT) AS rank
FROM part JOIN scores ON n = p_name WHERE score > 70 QUALIFY rank <= 3""",
}
