"""HTML pages: the shapes of a full, a sparse and a broken item page."""

import re

from catalog_engine.operators import html_fields as html

#: Parts of an item page, each with what its rule must not take.  Their order means nothing.
PARTS = {
    "makers": """<ul><li><a href="/noses/Ann.html"><img src="x"><span>Ann Bee</span> rest</a><li><a href="/noses/Cee.html">Cee</a>
<li><a href="/noses/Ann.html"><span>Ann Bee</span></a><li><a href="/noses/">All</a></ul>""",
    "prose": """<section itemprop="description"><p><b>Night Rose</b>by <b>Big
  House</b> was launched in 2015.<br>Top notes are A &amp; B.</p><blockquote><p>Marketing</p></blockquote></section>""",
    "votes": """<p>Rated&nbsp;<i itemprop="ratingValue"> 4.10 </i> by
<i itemprop="ratingCount" content="48120">48,120</i> votes</p>""",
    "accords": """<h6>MAIN Accords</h6><!-- x --><p>between</p>
<div><p><span class="truncate">Fresh Spicy</span><p><span class="truncate x">amber</span>
<p><span class="other">no</span></div>
<div><span class="truncate">not a sibling hit</span></div>""",
    "title": """<script>var t = "<h1 class='text-center'>no</h1>";</script>
<h1>Other</h1><h1 class="big text-center">
   Night Rose Big House for men
</h1>""",
}
FULL = "<!DOCTYPE html><head><style>h1 {x: y}</style></head><body>" + "".join(PARTS.values())

SPARSE = '<html><body><h1 class="text-center">Plain Rose</h1><a href="/noses/">All</a>'


def raw(spark, *pages):
    df = spark.createDataFrame([(f"u{i}", p) for i, p in enumerate(pages)], "url string, html string")
    return [r.asDict() for r in html.item_pages_to_raw(df).orderBy("url").collect()]


def test_full_page(spark):
    assert raw(spark, FULL) == [
        {
            "url": "u0",
            "name": "Night Rose Big House",
            "gender": "for men",
            "rating": "4.1",
            "rating_count": "48120",
            "main_accords": ["fresh spicy", "amber"],
            "perfumers": ["Ann Bee", "Cee"],
            "description": "Night Rose by Big House was launched in 2015. Top notes are A & B.",
        }
    ]


def test_parts_in_any_order(spark):
    import itertools

    first = {**raw(spark, FULL)[0], "url": None}
    orders = list(itertools.permutations(PARTS.values()))[::7]
    assert all({**row, "url": None} == first for row in raw(spark, *map("".join, orders)))


def test_sparse_and_missing_pages(spark):
    sparse, empty, none = raw(spark, SPARSE, "", None)
    assert sparse["name"] == "Plain Rose"
    for page in (sparse, empty, none):
        assert {page[c] for c in ("gender", "rating", "rating_count", "description")} == {"N/A"}
        assert page["main_accords"] == [] and page["perfumers"] == []
    assert empty["name"] == none["name"] == "N/A"


def test_count_from_text_and_unreadable_rating(spark):
    text = '<span itemprop="ratingValue">{}</span><i itemprop="ratingCount">1,234 votes</i>'
    good, bad = raw(spark, text.format("4"), text.format("n/a"))
    assert (good["rating"], good["rating_count"]) == ("4.0", "1234")
    assert (bad["rating"], bad["rating_count"]) == ("N/A", "N/A")


def test_title_suffix(spark):
    def title(t):
        row = raw(spark, f'<h1 class="text-center">{t}</h1>')[0]
        return row["name"], row["gender"]

    assert title("Rose For Women And Men") == ("Rose", "for women and men")
    assert title("Rose for women") == ("Rose", "for women")
    assert title("Rose for women only") == ("Rose for women only", "N/A")


def fields(spark, page, *rules):
    df = spark.createDataFrame([(1, page)], "id long, html string")
    return html.extract_html_fields(df, "html", rules).first().asDict()


def test_unclosed_and_stray_tags(spark):
    page = "<div id=a><p>one<p>two</b></div><p>three</i><br/><img>four</p></p>five"
    got = fields(
        spark,
        page,
        html.HtmlRule("first", (html.Find("div", {"id": "a"}), html.Find("p")), join="|"),
        html.HtmlRule("all", (html.Find("p"),), join="|", many=True),
        html.HtmlRule("none", (html.Find("table"),)),
    )
    assert got == {"id": 1, "first": "one|two", "all": ["one|two", "two", "three|four"], "none": None}


def test_malformed_sections_do_not_stop_the_job(spark):
    page = "<p>a</p><![foo]><p>b<![CDATA[ & c]]></p><![><p>d</p><![if x]><p>e</p><!"
    got = fields(spark, page, html.HtmlRule("all", (html.Find("p"),), many=True))
    assert got == {"id": 1, "all": ["a", "b& c", "d", "e"]}


def test_any_text_parses():
    import random

    parts = (
        "< > ! [ ] -- <! <![ <![CDATA[ ]]> <? ?> <p </p> <a|href= \" ' x & &# &#x110000; &#xD800; script> <script> "
        "</script <b/> <!DOCTYPE if é <textarea> <title> = /"
    ).split(" ")
    rng = random.Random(5)
    for _ in range(20_000):
        text = "".join(rng.choice(parts).replace("|", " ") for _ in range(rng.randint(1, 14)))
        page = html._Page(text)
        for rule in html.ITEM_PAGE:
            page.take(rule)
        "".join(page.texts).encode()


def test_attributes_patterns_and_siblings(spark):
    page = '<ul><li data-x="7">a</li><li data-x>b</li></ul><p>t</p><ol>c</ol><ol>d</ol>'
    got = fields(
        spark,
        page,
        html.HtmlRule("digits", (html.Find("li", {"data-x": re.compile(r"\d")}),), attr="data-x"),
        html.HtmlRule("attr_or_text", (html.Find("li", {"data-x": ""}),), attr="data-x"),
        html.HtmlRule("next", (html.Find("ul"), html.NextSibling("ol"))),
    )
    assert got == {"id": 1, "digits": "7", "attr_or_text": "b", "next": "c"}


def test_legacy_layout(spark):
    page = (
        '<meta property="og:url" content="https://x.org/A-1.html"><div class="cell accord-box"> woody </div>'
        '<div class="accord-box">no</div><div class="cell small-12" itemprop="description">For all</div>'
    )
    got = fields(spark, page, *html.ITEM_PAGE_LEGACY)
    assert got == {
        "id": 1, "url": "https://x.org/A-1.html", "rating": None, "rating_count": None,
        "main_accords": ["woody"], "description": "For all",
    }
