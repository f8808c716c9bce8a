
import pytest
from pyspark.sql import functions as F

from catalog_engine import rules
from catalog_engine.functions import text
from catalog_engine.operators.extract import extract_fields, stringify
from catalog_engine.plans.clean import clean_items

URL = "https://www.example.com/perfume/Big-House/Night-Rose-104.html"
PROSE = (
    "Night Rose by Big House was launched in 2023. Top notes are Pink Pepper and Rose; "
    "middle note is Jasmine; base notes are Musk, White Andes and Amber."
)


def extracted(spark, **values):
    row = {"url": URL, "description": PROSE, "main_accords": "['rose', 'warm spicy']"} | values
    df = spark.createDataFrame([tuple(row.values())], "url string, description string, main_accords string")
    return extract_fields(df, rules.ITEM_FIELDS).first().asDict()


def test_item_fields(spark):
    assert extracted(spark) == {
        "id": "104",
        "name": "Night Rose",
        "brand": "Big House",
        "release_year": "2023",
        "accords": "rose, warm spicy",
        "top_notes": "pink pepper, rose",
        "mid_notes": "jasmine",
        "base_notes": "musk, white andes, amber",  # D16: "andes" is not cut
    }


def test_no_match_is_null(spark):  # D3
    got = extracted(spark, url="https://x.org/other", description="Nothing here", main_accords="[]")
    assert set(got.values()) == {None}


def test_null_sources(spark):
    assert set(extracted(spark, url=None, description=None, main_accords=None).values()) == {None}


def test_dot_is_literal(spark):  # D1
    assert extracted(spark, url="https://x.org/perfume/A/B-1Xhtml")["id"] is None


@pytest.mark.parametrize(
    "title,want",
    [
        ("Rose for women and men", "unisex"),
        ("Rose for women", "women"),
        ("Rose for men", "men"),
        ("Rose for Men", None),
        ("Rose for men ", None),
        ("Rose", None),
        (None, None),
    ],
)
def test_suffix_category(one, title, want):
    assert one(text.suffix_category("t", rules.CATEGORY_SUFFIXES), t=title) == want


def test_contained_category(one):
    got = one(text.suffix_category("t", rules.CATEGORY_SUFFIXES, "contains"), t="This is FOR WOMEN who dare")
    assert got == "women"


@pytest.mark.parametrize(
    "value,want", [("48,120", 48120), (" 12 ", 12), ("12.5", None), ("N/A", None), ("", None), (None, None)]
)
def test_to_int(one, value, want):
    assert one(text.to_int("v"), v=value) == want


def test_to_decimal_and_key(one):
    assert str(one(text.to_decimal("v"), v="4.256")) == "4.26"
    assert one(text.to_decimal("v"), v="None") is None
    assert one(text.to_key("v"), v="20417") == 20417
    assert one(text.to_key("v"), v="ab12") is None  # D6: no failure under ANSI


def test_list_text(one):
    assert one(text.list_text_to_csv("v"), v="['rose', 'woody']") == "rose, woody"
    assert one(text.list_text_to_csv("v"), v="""["lily's", 'a']""") == '"lilys", a'  # D15
    assert one(text.list_text_to_array("v"), v="['rose', 'woody', ]") == ["rose", "woody"]
    assert one(text.list_text_to_array("v"), v="[]") == []
    assert one(text.list_text_to_array("v"), v="None") is None


def test_pasted_lines(one):
    assert one(text.lines_to_array("v"), v="\namber\n  warm spicy \n\n\tmusk\n") == ["amber", "warm spicy", "musk"]


@pytest.mark.parametrize(
    "value,want",
    [
        ("Eau de Parfum", "edp"),
        ("Rose eau de toilette 50", "rose edt 50"),
        ("x eau de cologne", "x edc"),
        ("Extrait de Parfum", "extrait"),
        ("parfum extrait", "extrait"),
        ("eau de parfumerie", "eau de parfumerie"),
        ("beau de parfum", "beau de parfum"),
        ("éeau de parfum", "éeau de parfum"),  # D14: a letter in any script
        ("eau de parfum eau de parfum", "edp edp"),
        ("plain", "plain"),
        (None, None),
    ],
)
def test_aliases(one, value, want):
    assert one(text.normalize_aliases("v", rules.PHRASE_ALIASES), v=value) == want
    if value is not None:
        assert text.normalize_term(value, rules.PHRASE_ALIASES) == want


def test_aliases_apply_in_order(one):
    chain = (("a b", "c"), ("c d", "$1\\x"))
    assert one(text.normalize_aliases("v", chain), v="A b d") == "$1\\x"
    assert text.normalize_term("A b d", chain) == "$1\\x"


def test_tag_bag(one):
    fields = [("accords_", "a"), ("top_notes_", "t"), ("mid_notes_", "m")]
    assert one(text.tag_bag(fields), a="rose, warm spicy", t=None, m="musk") == (
        "accords_rose accords_warm_spicy mid_notes_musk"
    )
    assert one(text.tag_bag(fields), a="", t=None, m="") == ""
    assert one(text.tag_bag(fields), a="rose,", t="x", m=None) == "accords_rose accords_ top_notes_x"


def test_display(one):
    assert one(text.or_label("v", "—"), v="") == "—"
    assert one(text.or_label("v", "—"), v=None) == "—"
    assert one(text.display_label("a", "b"), a="Rose", b="House") == "Rose — House"


def test_stringify_keeps_null(spark):
    df = spark.createDataFrame([("u", 3.5, ["a", "b"])], "url string, rating double, main_accords array<string>")
    got = stringify(df, ["url", "rating", "main_accords", "perfumers"]).first()
    assert tuple(got) == ("u", "3.5", "['a', 'b']", None)


RAW = "url string, name string, gender string, rating string, rating_count string, main_accords string, perfumers string, description string"


def raw(spark, *rows):
    base = dict(url=URL, name="T", gender=None, rating="4.1", rating_count="9", main_accords="['a']", perfumers="['P']", description=PROSE)
    return spark.createDataFrame([tuple((base | r).values()) for r in rows], RAW)


def test_most_rated_copy_wins(spark):  # D2
    rows = [{"rating_count": c, "rating": r} for c, r in (("9", "1"), ("48,120", "2"), ("N/A", "3"), (None, "4"))]
    assert clean_items(raw(spark, *rows)).first()["rating_count"] == 48120
    assert clean_items(raw(spark, *rows), order_as="string").first()["rating"] == 3  # 'N/A' sorts last as text


def test_gender_falls_back_to_raw(spark):  # D4, D5
    def gender(**r):
        return clean_items(raw(spark, r)).first()["gender"]

    assert gender(name="Rose for women", gender="for men") == "women"
    assert gender(name="Rose", gender="for women and men") == "unisex"
    assert gender(name="Rose", gender="unisex") == "unisex"
    assert gender(name="Rose", gender="N/A") is None


def test_clean_schema_has_no_rank(spark):  # D18
    from catalog_engine import schema

    got = clean_items(raw(spark, {}))
    assert got.columns == schema.CLEAN.names
    assert [f.dataType for f in got.schema] == [f.dataType for f in schema.CLEAN]


def test_bulk_equals_row_by_row(spark):
    rows = [{"url": URL.replace("104", str(i)), "rating_count": str(i)} for i in range(5)]
    bulk = {tuple(r) for r in clean_items(raw(spark, *rows)).collect()}
    single = {tuple(clean_items(raw(spark, r)).first()) for r in rows}
    assert bulk == single


def test_prose_with_quotes_is_data(spark):
    nasty = "It's \"new\" -- '; DROP TABLE x; was launched in 1999. Top notes are a and b."
    assert extracted(spark, description=nasty)["release_year"] == "1999"


def test_field_ok(one):
    assert one(text.field_ok("v"), v="x")
    assert not one(text.field_ok("v"), v="N/A")
    assert not one(text.field_ok("v"), v=None)
    assert not one(text.field_ok(F.array().cast("array<string>"), "array<string>"), v="x")


@pytest.mark.parametrize(
    "given, expected",
    [
        ("['rose', 'warm spicy']", "rose, warm spicy"),
        ("""["lily's", 'musk']""", "lily's, musk"),
        ("""['musk', "lily's"]""", "musk, lily's"),
        ("['lily's', 'musk']", "lily's, musk"),
        ("rose, musk", "rose, musk"),
        ("['a, b', 'c']", "a, b, c"),
        ("[]", None),
        ("None", None),
        ("N/A", None),
        ("['N/A']", None),
        ("", None),
        (None, None),
    ],
)
def test_list_text_entries(one, given, expected):  # D15
    assert one(text.list_text_entries("t"), t=given) == expected
