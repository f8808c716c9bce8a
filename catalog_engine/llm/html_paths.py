"""Main text of pages by tag-path ratios.

A page is read as a tree of elements.  Every text node adds its characters and
its punctuation to its tag path, the tag names from the root down.  A path whose
nodes are long and well punctuated is content; menus have many short nodes.

1. For each path: mean characters and mean punctuation marks per node.
2. Both are smoothed over paths in page order with a Gaussian window, and
   fused by multiplying them (one added to each).
3. Paths from ``THRESHOLD`` standard deviations below the mean up are content
   paths.  Characters and punctuation of content paths vote for the containers
   that hold them: every ``article`` or ``main`` (or element marked as such), else
   the deepest element that holds nearly all votes.
4. Text nodes of the containers are the content nodes, whatever their length, so
   that a title or a short paragraph stays; headers, menus, sidebars, notices,
   adverts, forms and comments inside are left out by their tag or marking.
5. Blocks on content paths beside the containers, and headings over what is kept,
   are content too: of the whole page, or where articles are marked between and
   next to them.  There the logarithms of the scores are compared.

A class or id named like boilerplate does not count on a heading, a cell, code or
an element inside a line, on what holds the article or most of the text, and with
"has", "no" or "with" before it.  Where it may as well come from the words of a
section, the ratios decide on a class, and on an id whether the text is more than
links.  So it does on a class that holds another word, too, such as
"market-share", unless one of its words means nothing but boilerplate.

Characters of a block are joined, references decoded, white space turned into
one space; blocks are joined by a line break.  ``br`` is white space.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import defaultdict
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog_engine.llm.common import arrow_schema, slices

THRESHOLD = 1.0
SMOOTHING = 1.0
# Share of the votes a container must hold.
HELD = 0.9

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
SKIPPED = frozenset(
    "head script style noscript template nav header footer aside button select option textarea input svg "
    "iframe object canvas title dialog menu label noembed noframes xmp".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small "
    "span strike strong sub sup time tt u var wbr".split()
)
#: A paragraph ends where one of these begins.
ENDS_PARAGRAPH = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hr main menu nav ol p pre section table ul".split()
)
#: Elements that end their like when they begin: what, and up to which ancestor.
ENDS_LIKE = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select",)),
}
#: Blocks too small to be a container.
LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd tr td th pre".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
BOILERPLATE = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|adslot|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notice|popup|modal|"
    r"dfp|outbrain|taboola|adsbygoogle|feedback|responses?|"
    r"newsletter|subscribe|paywall|comments?|commentlist|respond|replies|reply|disqus|discussion|sidebar|side-bar|widget\w*|nav|"
    r"navbar|navigation|menu|submenu|breadcrumbs?|pagination|pager|header|masthead|footer|related|recommend\w*|"
    r"share|sharing|social|toolbar|skip-link|login|signup|search)(?=$|[\s_-])",
    re.I,
)
#: Words of the list that articles are not about, whatever stands beside them.
ALWAYS = re.compile(
    r"(?:ads?|advert\w*|adsense|adslot|sponsor\w*|dfp|outbrain|taboola|adsbygoogle|cookies?|consent|gdpr|newsletter|"
    r"paywall|popup|modal|disqus|commentlist|sidebar|side-bar|breadcrumbs?|pagination|navbar|masthead|skip-link)",
    re.I,
)
#: Words beside them that say nothing of the content.
NEUTRAL = frozenset(
    "site page post posts entry article main global top bottom left right mid inner outer block box container wrapper wrap "
    "area list item items row col column primary secondary button buttons icon icons link links bar label title text body "
    "content form input panel overlay slot unit zone count meta author thread user reader readers visitor previous next "
    "inline native after before below above leaderboard section sticky fixed module group".split()
)
#: What a layout has or lacks says nothing about the element itself.
HAS = re.compile(r"(?:(?<=[\s_-])|^)(?:has|have|no|not|with|without)[_-]+\S*", re.I)
#: Words of the list that sections of an article are called by as well.
TOPIC = re.compile(r"[\s_-]*(?:discussion|related|recommend\w*|social|search)", re.I)
COMMENTS = re.compile(r"[\s\d_-]*comments?[\s\d_-]*", re.I)
#: Their ids never mark them.
NAMED_BY_TEXT = HEADINGS | INLINE | frozenset("p dt dd pre".split())
#: What is never left out for its class or id.
NEVER = (HEADINGS | INLINE | frozenset("html body article main th td tr thead tbody pre".split())) - {"a"}
#: How sure a mark of boilerplate is.
PERHAPS, SURELY = 1, 2
#: Fused ratio from which a block is prose, whatever else the page holds.
PROSE = 150.0
CONTENT = re.compile(
    r"(?:^|[\s_-])(?:article|post|entry|story|content|main)(?:[_-]?(?:body|content|text|main|area))?(?=$|[\s])", re.I
)
TAG = re.compile(r"<(?:!--|([!?])|(/?)([A-Za-z][^\s/>]*))")
#: Searched from the second pair of signs on: "<!-->" is a whole comment.
COMMENT_END = re.compile(r"--!?>")
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
TAG_END = re.compile(r"""(?:[^>"']|"[^"]*"|'[^']*')*>""")


class Node:
    __slots__ = ("tag", "parent", "path", "depth", "skipped", "content", "within", "order", "block", "link", "marks")

    def __init__(self, tag, parent, skipped, marks, order, path):
        self.tag, self.parent, self.skipped, self.marks, self.order = tag, parent, skipped, marks, order
        self.path, self.content = path, marks.article
        self.depth = parent.depth + 1 if parent else 0
        #: Whether an element around this one is marked as the article.
        self.within = bool(parent) and (parent.within or parent.content)
        self.block = parent.block if parent and tag in INLINE else self
        self.link = tag == "a" or bool(parent) and parent.link


def _attributes(source: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(source)}


class Marks(NamedTuple):
    """What the tag and the attributes of an element say of it."""

    #: Never part of the text.
    out: bool = False
    #: Marked as the article; by more than its class or id; as the main part of the page.
    article: bool = False
    strong: bool = False
    main: bool = False
    #: Named like boilerplate, and how far that counts against it: 0, PERHAPS or SURELY.
    named: bool = False
    boilerplate: int = 0
    #: Text outside of links speaks against it, prose or not.
    by_id: bool = False
    id: str = ""


def _boilerplate(tag: str, classes: str, name: str) -> tuple[int, bool]:
    """How far the names count, and whether text outside of links speaks against them.

    A class says what an element is, an id may come from the words of a section;
    so may a class of which the list has a part only.
    """
    level, other = 0, False
    for token in classes.split():
        hits = [m[0].strip("_- ") for m in BOILERPLATE.finditer(token)]
        if not hits:
            continue
        rest = [w for w in re.findall(r"[^\W\d_]+", BOILERPLATE.sub(" ", token)) if w.lower() not in NEUTRAL]
        if any(map(ALWAYS.fullmatch, hits)) or not rest and not all(map(TOPIC.fullmatch, hits)):
            # A part of a section's frame, when it is named after the section.
            if "section" not in token.lower() or any(map(ALWAYS.fullmatch, hits)):
                return SURELY, False
            rest = [token]
        level, other = PERHAPS, other or not rest
    words = [] if tag in NAMED_BY_TEXT else [m[0] for m in BOILERPLATE.finditer(name)]
    if words and not re.search(r"[^\W\d_]", BOILERPLATE.sub("", name)) and not all(map(TOPIC.fullmatch, words)):
        return SURELY, False
    return (PERHAPS if words else level), not other


def _marks(tag: str, source: str) -> Marks:
    if not source or source.isspace() or source == "/":
        strong = tag in ("article", "main")
        return Marks(tag in SKIPPED, strong, strong, tag == "main", False, SURELY if tag == "form" else 0)
    attributes = _attributes(source)
    classes, name, role = attributes.get("class", ""), attributes.get("id", ""), attributes.get("role")
    hidden = (
        "hidden" in attributes
        or attributes.get("aria-hidden") == "true"
        or re.search(r"display\s*:\s*none", attributes.get("style", ""))
    )
    strong = tag in ("article", "main") or role in ("main", "article") or attributes.get("itemprop") == "articleBody"
    article = strong or bool(CONTENT.search(f"{classes} {name}"))
    boilerplate, by_id = _boilerplate(tag, HAS.sub("", classes), HAS.sub("", name))
    named = boilerplate > 0
    if tag == "form":
        boilerplate = SURELY
    elif tag in NEVER:
        boilerplate = 0
    main = tag == "main" or role == "main"
    return Marks(bool(tag in SKIPPED or hidden or role in ROLES), article, strong, main, named, boilerplate, by_id, name)


def parse(source: str) -> tuple[list[Node], list[tuple[Node, str]]]:
    """Elements as they begin, and text nodes in page order with the elements that hold them.

    ``br`` is a text node of a line break.  A tag path is a number: pages may
    nest without bound.
    """
    root = Node("", None, False, Marks(), 0, 0)
    nodes, paths, opened = [root], {}, defaultdict(int)
    node, texts, at, size = root, [], 0, len(source)
    while at < size:
        m = TAG.search(source, at)
        if not m:
            texts.append((node, source[at:]))
            break
        if m.start() > at:
            texts.append((node, source[at : m.start()]))
        if m[3] is None:
            if m[1] is None:  # a comment
                end = COMMENT_END.search(source, m.end() - 2)
                at = end.end() if end else size
            else:
                end = source.find(">", m.end())
                at = size if end < 0 else end + 1
            continue
        tag = m[3].lower()
        closed = TAG_END.match(source, m.end())
        if closed:
            end = closed.end()
        else:  # an open quote: the tag ends at the next bracket, or the page ends inside it
            end = source.find(">", m.end()) + 1
            if not end:
                break
        attributes, at = source[m.end() : end - 1], end
        if m[2]:
            if opened[tag]:
                while node.tag != tag:
                    opened[node.tag] -= 1
                    node = node.parent
                opened[tag] -= 1
                node = node.parent
            continue
        if tag == "br":
            texts.append((node, "\n"))
        if tag in VOID:
            continue
        if tag in ENDS_PARAGRAPH:
            up = node
            while up.parent and up.tag != "p" and (up.tag in INLINE):
                up = up.parent
            if up.tag == "p":
                node = _close(node, up, opened)
        elif tag in ENDS_LIKE:
            likes, stops = ENDS_LIKE[tag]
            up, found = node, None
            while up.parent and up.tag not in stops:
                if up.tag in likes:
                    found = up
                up = up.parent
            if found:
                node = _close(node, found, opened)
        marks = _marks(tag, attributes)
        path = paths.setdefault((node.path, tag), len(paths) + 1)
        child = Node(tag, node, node.skipped or marks.out, marks, len(nodes), path)
        nodes.append(child)
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(source, at)
            end = close.start() if close else size
            texts.append((child, source[at:end]))
            at = end
            if close:
                end = source.find(">", at)
                at = size if end < 0 else end + 1
            continue
        if not (attributes.endswith("/") and tag in ("svg", "path", "g", "use")):
            node = child
            opened[tag] += 1
    return nodes, texts


def _close(node: Node, last: Node, opened: dict[str, int]) -> Node:
    """The element around ``last``, when everything from ``node`` up to ``last`` ends."""
    while True:
        opened[node.tag] -= 1
        if node is last:
            return node.parent
        node = node.parent


def _punctuation(text: str) -> int:
    return sum(1 for c in text if not c.isalnum() and not c.isspace() and unicodedata.category(c)[0] == "P")


def path_scores(texts: list[tuple[Node, str]]) -> dict[int, float]:
    """Smoothed and fused ratio of every tag path."""
    chars, marks, count = defaultdict(int), defaultdict(int), defaultdict(int)
    for node, text in texts:
        text = text.strip()
        if text:
            chars[node.path] += len(text)
            marks[node.path] += _punctuation(text)
            count[node.path] += 1
    if not count:
        return {}
    paths = list(count)
    ratios = np.array([[chars[p] / count[p], marks[p] / count[p]] for p in paths])
    reach = np.arange(-2, 3)
    weight = np.exp(-(reach**2) / (2 * SMOOTHING**2))
    smooth = np.zeros_like(ratios)
    total = np.zeros(len(paths))
    for r, w in zip(reach, weight):
        here = np.arange(max(0, -r), min(len(paths), len(paths) - r))
        smooth[here] += w * ratios[here + r]
        total[here] += w
    smooth /= total[:, None]
    fused = (1 + smooth[:, 0]) * (1 + smooth[:, 1])
    return dict(zip(paths, fused))


def content_floor(scores: dict[int, float]) -> float:
    """The score from which a path is a content path; scores are products, so their logarithms are averaged."""
    logs = np.log(list(scores.values()) or [1.0])
    return float(np.exp(logs.mean() - THRESHOLD * logs.std()))


def _leave_out(nodes: list[Node], texts: list[tuple[Node, str]]) -> None:
    """Skip what is named like boilerplate, where it is.

    An element around the article, or around most of the text where no article
    is marked, stays.  So does one that only may be boilerplate, inside an
    article or as a section, when most of its text is prose.
    """
    if not any(n.marks.boilerplate and not n.skipped for n in nodes):
        return
    size = len(nodes)
    votes, around, holds, suspected = [0.0] * size, [False] * size, [False] * size, [False] * size
    for node, text in texts:
        votes[node.order] += len(text.strip()) + _punctuation(text)
    for n in reversed(nodes[1:]):
        votes[n.parent.order] += votes[n.order]
        holds[n.order] = holds[n.order] or (n.marks.strong and not n.marks.named and votes[n.order] > 0)
        holds[n.parent.order] = holds[n.parent.order] or holds[n.order]
    for n in nodes[1:]:
        suspected[n.order] = suspected[n.parent.order] or n.marks.boilerplate > 0
    marked = [n for n in nodes if n.content and not n.skipped and votes[n.order]]
    clear = [n for n in marked if not suspected[n.order]]
    for n in marked:
        around[n.order] = n.marks.main
    strong = [n for n in marked if n.marks.strong and not n.marks.named]
    if strong and not any(n.marks.strong for n in clear):
        best = max(strong, key=lambda n: (votes[n.order], -n.order))
        around[best.order] |= all(votes[best.order] > votes[n.order] for n in clear)
    for n in reversed(nodes[1:]):
        # Beside a marked article, cards of other articles may be the longer half.
        most = holds[n.order] and votes[n.order] >= HELD * votes[0] if clear else 2 * votes[n.order] > votes[0]
        around[n.parent.order] |= around[n.order]
        around[n.order] |= most
    headings = _first_headings(nodes, texts)
    perhaps = []
    for n in nodes[1:]:
        n.skipped = n.skipped or n.parent.skipped
        if n.marks.boilerplate and not n.skipped and not around[n.order]:
            section = n.content or n.within or n.tag == "section" or headings[n.order]
            if section and (n.marks.boilerplate == PERHAPS or _named_by(headings[n.order], n.marks)):
                perhaps.append(n)
            else:
                n.skipped = True
    if not perhaps:
        return
    prose, free, chars = _prose(nodes, [(node, text) for node, text in texts if not node.skipped])
    for n in perhaps:
        found = free if n.marks.by_id else prose
        # The head of a section may be all that its frame holds.
        bare = n.within and n.marks.by_id and not chars[n.order]
        n.skipped = not bare and (not found[n.order] or 2 * found[n.order] < chars[n.order])
    for n in nodes[1:]:
        n.skipped = n.skipped or n.parent.skipped


def _first_headings(nodes: list[Node], texts: list[tuple[Node, str]]) -> list[str]:
    """The text of the first heading in every element."""
    found = [""] * len(nodes)
    for node, text in texts:
        if node.block.tag in HEADINGS:
            found[node.block.order] += text
    for n in reversed(nodes[1:]):
        found[n.parent.order] = found[n.order] or found[n.parent.order]
    return found


def _named_by(heading: str, marks: Marks) -> bool:
    """Whether an id is the words of a heading, and not those of a list of comments."""
    words = re.findall(r"\w+", heading.lower())
    return bool(words) and not COMMENTS.fullmatch(heading) and words == re.findall(r"[^\W_]+", marks.id.lower())


def _prose(nodes: list[Node], texts: list[tuple[Node, str]]) -> tuple[list[int], list[int], list[int]]:
    """Characters of every element besides headings: in long, punctuated blocks, outside of links, and all."""
    chars, prose, free, own, marks = ([0] * len(nodes) for _ in range(5))
    for node, text in texts:
        at, n = node.block.order, len(text.strip())
        if node.block.tag not in HEADINGS:
            chars[at] += n
            if not node.link:
                own[at] += n
                marks[at] += _punctuation(text)
    floor = min(PROSE, content_floor(path_scores(texts)))
    for n in reversed(nodes):
        at = n.order
        free[at] += own[at]
        if marks[at] and (1 + own[at]) * (1 + marks[at]) >= floor:
            prose[at] += own[at]
        if n.parent:
            for of in (chars, prose, free):
                of[n.parent.order] += of[at]
    return prose, free, chars


def _containers(nodes, texts, scores) -> list[Node]:
    """All outermost elements marked as the article, else the element that holds the votes of the content paths."""
    values = np.array(list(scores.values()))
    floor = values.mean() - THRESHOLD * values.std()
    votes = [0.0] * len(nodes)
    for node, text in texts:
        text = text.strip()
        if text and scores[node.path] >= floor:
            votes[node.order] += len(text) + _punctuation(text)
    for node in reversed(nodes[1:]):
        votes[node.parent.order] += votes[node.order]
    if not votes[0]:
        return []
    blocks = [n for n in nodes if votes[n.order] and n.tag not in INLINE and not n.skipped]
    outer = [n for n in blocks if n.content and not n.within]
    if outer:
        return outer
    held = [n for n in blocks if votes[n.order] >= HELD * votes[0] and n.tag not in LEAVES]
    return [max(held, key=lambda n: n.depth)]


def _beside(nodes, texts, scores, containers: list[Node], inside: list[bool]) -> set[int]:
    """Blocks outside of the containers that belong to them: those on content paths, and headings of what is kept.

    Where articles are marked, what is between them and what stands right beside
    them; else the whole page.  Blocks of links, and loose text that is short or
    has no punctuation, are not taken.
    """
    size = len(nodes)
    chars, linked, marks, holds, under = [0] * size, [0] * size, [0] * size, [0] * size, [False] * size
    content, order = [False] * size, []
    floor = content_floor(scores)
    for node, text in texts:
        stripped, at = text.strip(), node.block.order
        if stripped and not inside[at]:
            if not chars[at]:
                order.append(node.block)
            chars[at] += len(stripped)
            linked[at] += len(stripped) if node.link else 0
            marks[at] += _punctuation(stripped)
            content[at] |= scores[node.path] >= floor
        elif stripped and (not order or order[-1] is not None):
            order.append(None)
    if not any(order):
        return set()
    marked = containers[0].content
    for n in containers:
        holds[n.order] = 1
    for n in reversed(nodes[1:]):
        holds[n.parent.order] += holds[n.order]
    first, last = containers[0].order, containers[-1].order
    top = max((n for n in nodes if holds[n.order] == len(containers)), key=lambda n: n.depth) if marked else nodes[0]
    if top is containers[0] and top.parent:
        top = top.parent
    under[top.order] = True
    for n in nodes[1:]:
        under[n.order] = under[n.order] or under[n.parent.order]

    def belongs(n: Node) -> bool:
        at = n.order
        if 2 * linked[at] >= chars[at] or not content[at]:
            return False
        prose = marks[at] > 0 and (1 + chars[at]) * (1 + marks[at]) >= min(PROSE, floor)
        return prose or n.tag in LEAVES and not (marked and at > last)

    found, follows = set(), False
    for n in reversed(order):
        if n is None:
            follows = True
        elif not under[n.order] or marked and not (n.parent is top or n is top or first < n.order < last):
            follows = False
        elif n.tag in HEADINGS:
            if follows or n.tag == "h1" and n.order < last:
                found.add(n.order)
        else:
            follows = belongs(n)
            if follows:
                found.add(n.order)
    return found


def main_text(source: str) -> str:
    """The article of a page: its blocks, one to a line; empty when there is none."""
    nodes, texts = parse(source)
    texts = [(node, html.unescape(text)) for node, text in texts if text and not node.skipped]
    _leave_out(nodes, texts)
    texts = [(node, text) for node, text in texts if not node.skipped]
    scores = path_scores(texts)
    if not scores:
        return ""
    containers = _containers(nodes, texts, scores)
    if not containers:
        return ""
    inside = [False] * len(nodes)
    for node in containers:
        inside[node.order] = True
    for node in nodes[1:]:
        inside[node.order] = inside[node.order] or inside[node.parent.order]
    beside = _beside(nodes, texts, scores, containers, inside)
    blocks, held, last = [], [], None
    for node, text in texts:
        if inside[node.order] or node.block.order in beside:
            if node.block is not last:
                blocks.append(held)
                held, last = [], node.block
            held.append(text)
    blocks.append(held)
    lines = (" ".join("".join(b).split()) for b in blocks)
    return "\n".join(line for line in lines if line)


def extract_main_text(df: DataFrame, keep: tuple[str, ...] = ("page_id", "url"), html_col: str = "html") -> DataFrame:
    """One row per row of ``df``: the columns of ``keep``, ``text`` and ``n_chars`` (code points).

    Whole pages are read.  A null or empty page, and one without an article,
    has the empty text; malformed and cut pages are read as far as they go;
    repeated rows are kept; an empty table gives an empty one; columns outside
    ``keep`` are not read.
    """
    fields = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    out = arrow_schema(f"{fields}, text string")
    k = len(keep)

    def run(batches):
        for batch in batches:
            pages = batch.column(k).to_pylist()
            for part in slices(pages):
                some = batch.slice(part.start, part.stop - part.start)
                found = pa.array([main_text(p) for p in pages[part]], pa.string())
                yield pa.RecordBatch.from_arrays([*some.columns[:k], found], schema=out)

    rows = df.select(*keep, F.coalesce(F.col(html_col), F.lit("")).alias("__html"))
    found = rows.mapInArrow(run, f"{fields}, text string")
    return found.withColumn("n_chars", F.char_length("text").cast("long"))
