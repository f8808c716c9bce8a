"""Marks of boilerplate inside articles, and path ratios against a plain version."""

import math
import unicodedata
from collections import defaultdict

import pyarrow.parquet as pq
import pytest

from catalog_engine.llm import html_paths

SF = "/root/testdata/sf0.01"
LONG = "A long paragraph stands here, with commas, and with a full stop. It goes on; and on, until it ends."


def article(inside):
    return f"<body><nav><a>Home</a></nav><article><p>{LONG}</p>{inside}<p>{LONG}</p></article></body>"


@pytest.mark.parametrize(
    "inside,line",
    [
        ('<pre>x = 1 <span class="hljs-comment"># set x</span> y</pre>', "x = 1 # set x y"),
        ('<div class="section-header"><h2>Results</h2></div>', "Results"),
        (f'<div class="market-share"><p>{LONG} The share.</p></div>', f"{LONG} The share."),
        ('<div class="market-share"><p>Few words</p></div>', "Few words"),
        ('<table><tr><th class="header">Column</th></tr></table>', "Column"),
        ('<figure class="widget-figure"><figcaption>A caption</figcaption></figure>', "A caption"),
        ('<div class="code-login"><pre>login()</pre></div>', "login()"),
        ('<div class="code-comment">note it</div>', "note it"),
        ("<p>one</p><!-- a --!><p>two</p>", "two"),
        ("<!--><p>two</p>", "two"),
        ("<!---><p>two</p>", "two"),
        ("<!-- <p>no</p> --><p>two</p>", "two"),
    ],
)
def test_what_stays(inside, line):
    lines = html_paths.main_text(article(inside)).split("\n")
    assert line in lines and lines[0] == lines[-1] == LONG and "no" not in lines


@pytest.mark.parametrize(
    "inside",
    [
        '<div class="dfp-slot">Buy now! It is cheap, and good.</div>',
        '<div class="outbrain">Buy now! It is cheap, and good.</div>',
        '<div class="mid-article-ad">Buy now! It is cheap.</div>',
        '<div class="share-buttons">Buy now</div>',
        '<a class="share-link" href="x">Share</a>',
        f'<div class="feedback-list"><p>Nice! {LONG}</p></div>',
        f'<section id="responses"><div class="response"><p>Nice! {LONG}</p></div></section>',
        f'<div class="user-comments"><p>Nice! {LONG}</p></div>',
        f'<div class="cookie-notice"><p>Mind: {LONG}</p></div>',
        '<div class="related-stories"><ul><li><a href="x">One more</a></li><li><a href="y">And more</a></li></ul></div>',
        "<!-- never closed <p>x</p>",
    ],
)
def test_what_goes(inside):
    text = html_paths.main_text(article(inside))
    assert text.split("\n") == ([LONG] if "never" in inside else [LONG, LONG])


def plain_scores(texts):
    """The same ratios by the names of the paths, step by step."""
    order, seen = [], defaultdict(list)
    for node, text in texts:
        names, n = [], node
        while n:
            names.append(n.tag)
            n = n.parent
        path, text = "/".join(reversed(names)), text.strip()
        if text:
            order += [path] if path not in seen else []
            marks = sum(unicodedata.category(c).startswith("P") for c in text)
            seen[path].append((len(text), marks))
    means = [[sum(x) / len(seen[p]) for x in zip(*seen[p])] for p in order]
    fused = {}
    for i, path in enumerate(order):
        near = [j for j in range(i - 2, i + 3) if 0 <= j < len(order)]
        weights = [math.exp(-((j - i) ** 2) / 2) for j in near]
        chars, marks = (sum(w * means[j][k] for w, j in zip(weights, near)) / sum(weights) for k in (0, 1))
        fused[path] = (1 + chars) * (1 + marks)
    return fused


def test_path_ratios_equal_a_plain_version_on_all_pages():
    pages = pq.read_table(f"{SF}/pages.parquet", columns=["html"]).column("html").to_pylist()
    assert len(pages) == 250
    for page in pages:
        texts = [(n, t) for n, t in html_paths.parse(page or "")[1] if t and not n.skipped]
        got, want = html_paths.path_scores(texts), plain_scores(texts)
        assert len(got) == len(want) and all(math.isclose(a, b, rel_tol=1e-9) for a, b in zip(got.values(), want.values()))
