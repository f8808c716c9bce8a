"""Random inputs against plain Python."""

from collections import Counter

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from catalog_engine.functions import text
from catalog_engine.operators import changes
from catalog_engine.operators.dedupe import dedupe_best
from catalog_engine.operators.upsert import upsert
from pyspark.sql import functions as F

few = settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
keys = st.one_of(st.none(), st.integers(0, 6))
words = st.one_of(st.none(), st.sampled_from(["", "a", "b", "c d", "é"]))


def bag(df):
    return Counter(tuple(r) for r in df.collect())


@few
@given(
    st.lists(st.tuples(keys, words, words), max_size=12),
    st.lists(st.tuples(keys, words), max_size=8, unique_by=lambda r: object() if r[0] is None else r[0]),
)
def test_upsert(spark, target, source):
    t = spark.createDataFrame(target, "k long, a string, b string")
    s = spark.createDataFrame(source, "k long, a string")
    new = {k: a for k, a in source if k is not None}
    stored = {k for k, _, _ in target}
    inserted = Counter((k, a, None) for k, a in source if k is None or k not in stored)

    kept = Counter((k, new[k], b) if k is not None and k in new else (k, a, b) for k, a, b in target)
    assert bag(upsert(t, s, "k", ["a"])) == kept + inserted

    whole = s.withColumn("b", F.lit("z"))
    kept = Counter(r for r in target if r[0] is None or r[0] not in new)
    assert bag(upsert(t, whole, "k")) == kept + Counter((k, a, "z") for k, a in source)


@few
@given(st.lists(st.tuples(keys, words), max_size=10), st.lists(st.tuples(keys, words), max_size=10))
def test_key_filters(spark, items, stored):
    i = spark.createDataFrame(items, "k long, t string")
    s = spark.createDataFrame(stored, "k long, t string")
    have = {k for k, _ in stored if k is not None}
    assert bag(changes.rows_in(i, s, "k")) == Counter(r for r in items if r[0] in have)
    assert bag(changes.new_rows(i, s, "k")) == Counter(r for r in items if r[0] not in have)
    same = {r for r in stored if None not in r}
    want = Counter(r for r in items if r[1] is not None and r not in same)
    assert bag(changes.stale_rows(i, s, "k", "t")) == want


@few
@given(st.lists(st.tuples(keys, st.integers(0, 3), st.integers(0, 99)), max_size=20, unique_by=lambda r: r[2]))
def test_dedupe(spark, rows):
    df = spark.createDataFrame(rows, "k long, v long, i long")
    best = {}
    for r in sorted(rows, key=lambda r: (-r[1], r[2])):
        best.setdefault(r[0], r)
    assert bag(dedupe_best(df, ["k"], [F.desc("v"), F.asc("i")])) == Counter(best.values())


lists = st.one_of(st.none(), st.text(alphabet="ab ,_é", max_size=12))


@few
@given(st.lists(st.tuples(lists, lists), min_size=1, max_size=20))
def test_tag_bag(spark, rows):
    def plain(*fields):
        tags = [p + w.strip(" ").replace(" ", "_") for p, c in fields if c for w in c.split(",")]
        return " ".join(tags).strip(" ")

    df = spark.createDataFrame(rows, "x string, y string")
    got = [r[0] for r in df.select(text.tag_bag([("x_", "x"), ("y_", "y")])).collect()]
    assert got == [plain(("x_", x), ("y_", y)) for x, y in rows]


phrases = st.lists(
    st.sampled_from(["eau de parfum", "eau de", "parfum extrait", "extrait de parfum", "é", "-", "b", "_"]), max_size=6
)


@few
@given(st.lists(st.tuples(phrases, st.sampled_from(["", " ", "  "])), min_size=1, max_size=20))
def test_aliases_in_column_and_term(spark, rows):
    from catalog_engine import rules

    values = [glue.join(parts) for parts, glue in rows]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    got = [r[0] for r in df.select(F.trim(text.normalize_aliases("v", rules.PHRASE_ALIASES))).collect()]
    assert got == [text.normalize_term(v, rules.PHRASE_ALIASES).strip(" ") for v in values]
