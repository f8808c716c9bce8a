"""Field extraction from HTML pages.

A rule walks a page in steps - find an element, go to the next sibling, find
inside it - and takes text or an attribute.  Python only does that walk;
everything after it (suffix split, digits, lower case, distinct) is left to
column expressions.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalog_engine import rules, runtime
from catalog_engine.functions import text
from catalog_engine.operators.extract import field_column

# Elements that never have content (HTML standard).
VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
HIDDEN = frozenset(("script", "style", "template"))
_NO_ATTRS: dict[str, str] = {}


@dataclass(frozen=True)
class Find:
    """Elements below the current one, in page order.

    ``attrs`` maps an attribute to a literal, or to a compiled pattern that is
    searched for; a literal class matches one of the classes or all of them.
    ``heading`` asks for an element whose only text contains it, ignoring case.
    """

    tag: str | None = None
    attrs: Mapping[str, str | re.Pattern] = field(default_factory=dict)
    heading: str | None = None


@dataclass(frozen=True)
class NextSibling:
    tag: str


@dataclass(frozen=True)
class Prefer:
    """The first such element inside, or else the current one."""

    tag: str


@dataclass(frozen=True)
class HtmlRule:
    """``steps`` to an element, then its text or the first attribute that is set.

    ``join`` puts the stripped pieces of text together; None takes the text as
    it stands, trimmed.  ``many`` collects all elements of the last Find.
    """

    name: str
    steps: tuple[Find | NextSibling | Prefer, ...]
    attr: str | None = None
    join: str | None = ""
    many: bool = False


class _Page(HTMLParser):
    """Elements in page order; an element's subtree is the range up to its ``end``."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.tags: list[str] = [""]
        self.attrs: list[dict[str, str]] = [{}]
        self.parent: list[int] = [-1]
        self.end: list[int] = [0]
        self.text_from: list[int] = [0]
        self.text_to: list[int] = [0]
        self.texts: list[str] = []
        self.with_tag: dict[str, list[int]] = {}
        self.open = [0]
        self.feed(html)
        self.close()
        self._close_down_to(0)
        self._seal(0)

    def handle_starttag(self, tag, attrs):
        node = len(self.tags)
        self.tags.append(tag)
        self.with_tag.setdefault(tag, []).append(node)
        self.attrs.append({k: v or "" for k, v in reversed(attrs)} if attrs else _NO_ATTRS)
        self.parent.append(self.open[-1])
        self.end.append(0)
        self.text_from.append(len(self.texts))
        self.text_to.append(0)
        if tag in VOID:
            self._seal(node)
        else:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        self.handle_endtag(tag)

    def handle_endtag(self, tag):
        for depth in range(len(self.open) - 1, 0, -1):
            if self.tags[self.open[depth]] == tag:
                self._close_down_to(depth - 1)
                return

    def handle_data(self, data):
        if self.tags[self.open[-1]] not in HIDDEN:
            self.texts.append(data)

    def unknown_decl(self, data):
        if data.startswith("CDATA["):
            self.handle_data(data[len("CDATA["):])

    def parse_marked_section(self, i, report=1):
        try:
            return super().parse_marked_section(i, report)
        except AssertionError:  # "<![" and no such section: a comment, by the HTML standard
            return self.parse_bogus_comment(i)

    def _close_down_to(self, depth: int):
        while len(self.open) > depth + 1:
            self._seal(self.open.pop())

    def _seal(self, node: int):
        self.end[node] = len(self.tags)
        self.text_to[node] = len(self.texts)

    # -- rules ---------------------------------------------------------

    def strings(self, node: int) -> list[str]:
        return self.texts[self.text_from[node] : self.text_to[node]]

    def _matches(self, node: int, step: Find) -> bool:
        for name, want in step.attrs.items():
            have = self.attrs[node].get(name)
            if have is None:
                return False
            if isinstance(want, re.Pattern):
                if not want.search(have):
                    return False
            elif have != want and not (name == "class" and want in have.split()):
                return False
        if step.heading is not None:
            own = self.strings(node)
            return len(own) == 1 and step.heading.lower() in own[0].lower()
        return True

    def _below(self, node: int, tag: str | None) -> Sequence[int]:
        """Elements inside ``node``, in page order."""
        if tag is None:
            return range(node + 1, self.end[node])
        found = self.with_tag.get(tag, [])
        return found[bisect_right(found, node) : bisect_left(found, self.end[node])]

    def _walk(self, nodes: Iterator[int], step) -> Iterator[int]:
        for node in nodes:
            if isinstance(step, Find):
                for below in self._below(node, step.tag):
                    if self._matches(below, step):
                        yield below
            elif isinstance(step, NextSibling):
                after = self.end[node]
                while after < self.end[self.parent[node]]:
                    if self.tags[after] == step.tag:
                        yield after
                        break
                    after = self.end[after]
            else:
                yield next(iter(self._below(node, step.tag)), node)

    def take(self, rule: HtmlRule):
        nodes: Iterator[int] = iter([0])
        last_find = max((i for i, s in enumerate(rule.steps) if isinstance(s, Find)), default=-1)
        for i, step in enumerate(rule.steps):
            nodes = self._walk(nodes, step)
            if not (rule.many and i >= last_find):
                nodes = iter([n for n in [next(nodes, None)] if n is not None])
        values = [self._value(node, rule) for node in nodes]
        if rule.many:
            return [v for v in values if v]
        return values[0] if values else None

    def _value(self, node: int, rule: HtmlRule) -> str:
        if rule.attr is not None and self.attrs[node].get(rule.attr):
            return self.attrs[node][rule.attr]
        pieces = self.strings(node)
        if rule.join is None:
            return "".join(pieces).strip()
        return rule.join.join(s for s in map(str.strip, pieces) if s)


#: Bytes of pages whose fields a worker holds at once.
PIECE_BYTES = 1 << 20


def pieces(batch: pa.RecordBatch, column: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """``batch`` in row ranges with about ``limit`` bytes in ``column``, at least one row each."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start = held = 0
    for i, size in enumerate(sizes.tolist()):
        if i > start and held + size > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size
    if start < batch.num_rows:
        yield batch.slice(start)


def extract_html_fields(df: DataFrame, html: str, page_rules: Sequence[HtmlRule]) -> DataFrame:
    """``df`` without its HTML column, plus one column per rule.

    A rule gives text, or an array of texts with ``many``.  Nothing found is
    NULL or an empty array.
    """
    page_rules = tuple(page_rules)
    kept = [f for f in df.schema.fields if f.name != html]
    kinds = [("array<string>" if r.many else "string") for r in page_rules]
    types = [pa.list_(pa.string()) if r.many else pa.string() for r in page_rules]
    schema = ", ".join(
        [f"`{f.name}` {f.dataType.simpleString()}" for f in kept]
        + [f"`{r.name}` {k}" for r, k in zip(page_rules, kinds)]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in pieces(batch, html):
                pages = (_Page(h.as_py() or "") for h in some.column(html))
                found = list(zip(*[[p.take(r) for r in page_rules] for p in pages]))
                yield pa.RecordBatch.from_arrays(
                    [some.column(f.name) for f in kept] + [pa.array(v, type=t) for v, t in zip(found, types)],
                    names=[f.name for f in kept] + [r.name for r in page_rules],
                )

    return runtime.spread(df.select(*[f.name for f in kept], html)).mapInArrow(run, schema)


# --------------------------------------------------------------------------
# The markup of an item page.
# --------------------------------------------------------------------------

ITEM_PAGE = (
    HtmlRule("title", (Find("h1", {"class": "text-center"}),), join=None),
    HtmlRule("rating", (Find(attrs={"itemprop": "ratingValue"}),)),
    HtmlRule("rating_count", (Find(attrs={"itemprop": "ratingCount"}),), attr="content"),
    HtmlRule(
        "main_accords",
        (Find("h6", heading="main accords"), NextSibling("div"), Find("span", {"class": "truncate"})),
        many=True,
    ),
    HtmlRule("perfumers", (Find("a", {"href": re.compile(r"^/noses/.+")}), Prefer("span")), many=True),
    HtmlRule("description", (Find(attrs={"itemprop": "description"}), Find("p")), join=" "),
)

# The older page layout: address in a meta tag, one box per accord.
ITEM_PAGE_LEGACY = (
    HtmlRule("url", (Find("meta", {"property": "og:url"}),), attr="content"),
    HtmlRule("rating", (Find("span", {"itemprop": "ratingValue"}),), join=None),
    HtmlRule("rating_count", (Find("span", {"itemprop": "ratingCount"}),), join=None),
    HtmlRule("main_accords", (Find("div", {"class": "cell accord-box"}),), join=None, many=True),
    HtmlRule(
        "description", (Find("div", {"class": "cell small-12", "itemprop": "description"}),), join=None
    ),
)


def item_pages_to_raw(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Item pages to scraped records, one per page.

    The title's trailing "for ..." becomes ``gender``; what the page lacks is
    the missing mark, or an empty list.
    """
    found = extract_html_fields(pages.select(F.col(url).alias("url"), html), html, ITEM_PAGE)
    gender = text.extract("title", rules.TITLE_CATEGORY_PATTERN, 0)
    named = F.regexp_replace("title", r"(?U)\s*" + rules.TITLE_CATEGORY_PATTERN, "")
    rating = F.col("rating").try_cast("double")
    # An unreadable rating makes the whole rating block untrusted.
    count = F.when(
        F.col("rating").isNull() | rating.isNotNull(),
        F.regexp_replace("rating_count", "[^0-9]", "").try_cast("bigint"),
    )

    def marked(c: Column) -> Column:
        return F.coalesce(c, F.lit(rules.MISSING_MARK))

    return found.select(
        "url",
        marked(named).alias("name"),
        marked(F.lower(gender)).alias("gender"),
        marked(rating.cast("string")).alias("rating"),
        marked(count.cast("string")).alias("rating_count"),
        F.transform("main_accords", F.lower).alias("main_accords"),
        F.array_distinct("perfumers").alias("perfumers"),
        marked(F.regexp_replace("description", r"(?U)\s+", " ")).alias("description"),
    )


def legacy_pages_to_raw(pages: DataFrame, segment: str, html: str = "html") -> DataFrame:
    """Pages of the older layout to whole scraped records, with the ``id`` and ``brand`` of their address.

    Everything comes from the page itself: its address from a meta tag; name,
    brand and id from the address, for the brand whose URL segment is
    ``segment``; the category from the prose, wherever it stands there.  What the
    page lacks is the missing mark, an empty list, or a NULL id or brand; the
    layout has no perfumers.
    """
    found = extract_html_fields(pages.select(html), html, ITEM_PAGE_LEGACY)
    named = {rule.name: field_column(rule) for rule in rules.one_brand_fields(segment)}
    labels = tuple((label, label) for label, _ in rules.CATEGORY_SUFFIXES)

    def marked(c: Column) -> Column:
        return F.coalesce(text.blank_to_null(c), F.lit(rules.MISSING_MARK))

    return found.select(
        "url",
        marked(named["name"]).alias("name"),
        marked(text.suffix_category("description", labels, "contains")).alias("gender"),
        marked(F.col("rating")).alias("rating"),
        marked(F.col("rating_count")).alias("rating_count"),
        "main_accords",
        F.array().cast("array<string>").alias("perfumers"),
        marked(F.col("description")).alias("description"),
        named["id"].alias("id"),
        named["brand"].alias("brand"),
    )
