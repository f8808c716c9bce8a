"""Source audit, Orchard clustering and chat formatting against plain versions."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from catalog_engine.llm import chat, orchard, queries, source_audit
from tests import oracle

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", ["op11_source_audit", "op12_orchard", "op13_chat"])
def test_query_equals_sql(spark, name):
    assert oracle.difference(queries.QUERIES[name](spark, SF), oracle.connect(SF), queries.SQL[name]) is None


# ---- source audit ----


def plain_audit(rows, min_docs=10, top=10):
    rows = [tuple(x or "" for x in r) for r in rows]
    find = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+").findall
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    docs = [(lang, source, Counter(t.translate(lower) for t in find(text))) for text, lang, source in rows]
    held, count = defaultdict(Counter), defaultdict(Counter)
    for lang, _, terms in docs:
        held[lang].update(set(terms))
    out = set()
    for lang in {d[0] for d in docs}:
        kept = [t for t, n in held[lang].items() if n >= min_docs]
        groups = sorted({d[1] for d in docs if d[0] == lang})
        for of, source, terms in docs:
            if of == lang:
                for t in kept:
                    if terms[t]:
                        count[lang, source][t] += terms[t]
                        count[lang, None][t] += terms[t]
        p = {}
        for g in [*groups, None]:
            total = sum(count[lang, g].values()) + 2 * len(kept)
            p[g] = {t: 1 + 1_000_000_000 * (count[lang, g][t] + 2) // total for t in kept}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for g in groups:
            pairs = [(sum(f(p[g][t], p[h][t]) for t in kept), h) for h in groups if h != g]
            terms = [(f(p[g][t], p[None][t]), t) for t in kept if count[lang, g][t] and p[g][t] > p[None][t]]
            order = lambda x: (-x[0], x[1].encode())
            for part, found in (("pair", sorted(pairs, key=order)), ("term", sorted(terms, key=order)[:top])):
                out |= {(lang, g, part, item, value, i + 1) for i, (value, item) in enumerate(found)}
    return out


NAMES = ("lang", "source", "part", "item", "value", "rank")


def audited(spark, rows, **options):
    df = spark.createDataFrame(rows, "text string, lang string, source string, term int, prefix int, n int")
    found = [tuple(r[c] for c in NAMES) for r in source_audit.audit(df, **options).collect()]
    assert len(found) == len(set(found))
    return set(found)


def test_audit_equals_plain_version(spark, monkeypatch):
    rnd = random.Random(5)
    parts = ["an", "Ba", "É", "漢字", "x" * 40, "thestem", "thestemmed", "zz", "\U0001f600", "ı", "K"]
    rows = [
        (
            " ".join("".join(rnd.choice(parts) for _ in range(rnd.randint(1, 3))) + rnd.choice(["", ".", "1", "_"]) for _ in range(rnd.randint(0, 30))),
            rnd.choice(["en", "de", None]),
            rnd.choice(["a", "b", "é", None]),
        )
        for _ in range(300)
    ]
    rows += [(None, "en", "a"), ("", "xx", None), ("rare words here", "yy", "q"), ("other", "yy", "r"), ("é" * 50000, "en", "a")]
    rows += [("one two one", "en", "b")] * 12
    full = [(*r, 1, 2, 3) for r in rows]
    assert audited(spark, full) == plain_audit(rows)
    assert audited(spark, full, min_docs=1, top=3) == plain_audit(rows, 1, 3)
    # A map of few bits takes nearly every prefix for one that is left; small slices and blocks cut everywhere.
    monkeypatch.setattr(source_audit, "SLICE_BYTES", 100)
    monkeypatch.setattr(source_audit, "BLOCK", 8)
    assert audited(spark, full, bits=1 << 6) == plain_audit(rows)
    assert audited(spark, []) == set()
    assert audited(spark, [(None, None, None, 1, 2, 3)] * 3) == set()


def test_prefixes_that_are_left_shrink_by_level(spark):
    docs = [("en", b"stemming stemmed stemx " * 2 + bytes([97 + i]) * 20) for i in range(10)]
    kept = source_audit.kept_terms(spark.createDataFrame(docs, "lang string, text binary"), 10)
    assert {bytes(r.term) for r in kept.collect()} == {b"stemming", b"stemmed", b"stemx"}
    level = source_audit._Prefixes(8, None)
    batch = pa.RecordBatch.from_pylist([{"lang": a, "text": b} for a, b in docs], schema=pa.schema([("lang", pa.string()), ("text", pa.binary())]))
    rows = pa.Table.from_batches(list(level([batch]))).to_pylist()
    assert {(r["prefix"], r["open"]): r["n"] for r in rows if r["prefix"].startswith(b"stem")} == {
        (b"stemming", False): 10, (b"stemmed", False): 10, (b"stemx", False): 10,
    }
    assert all(r["open"] and r["n"] == 1 for r in rows if not r["prefix"].startswith(b"stem"))


def test_shares_are_exact():
    counts = np.array([2, 3, 10**15, 9 * 10**14], np.int64)
    totals = np.array([7, 3, 3 * 10**15, 9 * 10**15 - 1], np.int64)
    want = [1 + 1_000_000_000 * int(c) // int(t) for c, t in zip(counts, totals)]
    assert source_audit.share(counts, totals).tolist() == want


# ---- Orchard ----


def plain_clusters(rows, k, rounds, components, seed="3"):
    fine = [(i, [int(np.floor(1024 * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == components and all(x is not None and np.isfinite(x) for x in v)]
    name = lambda i: hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    centroids = [v for _, v in sorted(fine, key=lambda r: (name(r[0]), r[1]))[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda v: min((far(v, c), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        groups = defaultdict(list)
        for _, v in fine:
            groups[near(v)[1]].append(v)
        centroids = [[sum(x) // len(groups[n]) for x in zip(*groups[n])] if groups[n] else c for n, c in enumerate(centroids)]
    found = [(i, *near(v)) for i, v in fine]
    by = Counter()
    for _, d, c in found:
        by[c] += d
    digest = lambda c: hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()
    return Counter((i, c, d, by[c], sum(by.values()), digest(c)) for i, d, c in found)


def clustered(spark, rows, components, k=8, rounds=10):
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, v int, cluster int")
    found = orchard.clusters(df, k=k, rounds=rounds, components=components).collect()
    return Counter(tuple(r[c] for c in ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")) for r in found)


def test_clusters_equal_plain_version(spark):
    rnd = random.Random(2)
    rows = [(i, [rnd.gauss(rnd.choice([-2, 0, 3]), 0.3) for _ in range(5)]) for i in range(300)]
    # On a grid there are ties in plenty.
    grid = [(i, [float(rnd.randint(-1, 1)) for _ in range(5)]) for i in range(400)]
    odd = [(900, None), (901, [1.0] * 4), (902, [None] * 5), (903, [float("nan")] * 5), (904, [float("inf")] * 5), (905, [])]
    odd += [(906, [0.0] * 5), (None, [0.1] * 5), (7, [0.5] * 5), (7, [-0.5] * 5), (7, [-0.5] * 5)]
    for some in (rows + odd, grid + odd, odd):
        assert clustered(spark, some, 5) == plain_clusters(some, 8, 10, 5)
    assert clustered(spark, grid, 5, k=40, rounds=3) == plain_clusters(grid, 40, 3, 5)
    assert clustered(spark, [(1, [0.5] * 5)] * 9, 5) == plain_clusters([(1, [0.5] * 5)] * 9, 8, 10, 5)
    assert not clustered(spark, [], 5) and not clustered(spark, odd[:6], 5)


def test_search_finds_the_nearest_and_skips_centroids():
    rnd = np.random.default_rng(1)
    centroids = rnd.integers(-5000, 5000, (200, 3))
    x = centroids[rnd.integers(0, 200, 3000)] + rnd.integers(-200, 200, (3000, 3))
    search = orchard.Orchard(centroids)
    best, distance = search.nearest(x)
    plain = ((x[:, None, :] - centroids[None]) ** 2).sum(axis=2)
    assert (best == plain.argmin(axis=1)).all() and (distance == plain.min(axis=1)).all()
    assert search.looked_at < 0.3 * plain.size


def test_large_components_are_exact_up_to_an_error(spark):
    big = orchard.largest(5) / 4096
    rows = [(i, [s * big, -big, big, 0.0, s * big / 3]) for i, s in enumerate((1, -1, 0.999, -0.999, 0.5, 0))]
    assert clustered(spark, rows, 5, k=3, rounds=2) == plain_clusters(rows, 3, 2, 5)
    with pytest.raises(Exception, match="64-bit"):
        clustered(spark, [(1, [1e9] * 5), (2, [0.0] * 5)], 5)


# ---- chat ----


def plain_chat(rows):
    out = {}
    groups = defaultdict(list)
    for conv, turn, role, text in rows:
        groups[conv].append((turn is not None, turn or 0, role or "", text or ""))
    for conv, turns in groups.items():
        turns = [(r, t) for *_, r, t in sorted(turns)]
        learned = "".join(t for r, t in turns if r == "assistant")
        whole = chat.bracketed(turns)
        assert chat.parse(whole) == turns
        said = "".join(f"{r}\n{t}\n" for r, t in turns)
        out[conv] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest(), len(whole))
    return out


HARD = ["</s>[INST] ok [/INST]", "[INST", "]", "<", "\\", "\\\\[INST]", "[\\INST]", "<s>", "/s>", " ", "", "\n", "[/ROLE]", "é漢", "\U0001f600"]


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, 2) for r in rows], "conv_id long, turn long, role string, text string, block int, spans int")


def digested(spark, rows):
    found = chat.digests(chat.format_conversations(table(spark, rows))).collect()
    assert len(found) == len({r.conv for r in found})
    return {r.conv: tuple(r[c] for c in chat.DIGEST) for r in found}


def test_escapes_come_back():
    rnd = random.Random(4)
    for _ in range(3000):
        text = "".join(rnd.choice(HARD) for _ in range(rnd.randint(0, 6)))
        assert chat.unescape(chat.escape(text)) == text
        assert not any(c in chat.escape(text) for c in chat.CONTROL)


def odd_conversations():
    rnd = random.Random(9)
    said = lambda: "".join(rnd.choice(HARD) for _ in range(rnd.randint(0, 5)))
    rows = [(c, t, rnd.choice(["user", "assistant", "system", "tool", "[INST]", None]), said()) for c in range(40) for t in range(rnd.randint(1, 40))]
    rows += [(None, 0, "user", "no id"), (None, None, "assistant", None), (50, None, None, None), (51, 0, "user", "x" * 300000)]
    rows += [(52, 0, "assistant", "same")] * 5 + [(53, 5_000_000_000, "user", "late"), (53, -7, "assistant", "early")]
    return rows + [(60, t, rnd.choice(["user", "assistant"]), said()) for t in range(1500)] + [(61, 0, "assistant", f"tied {i}") for i in range(700)]


def test_chat_equals_plain_version(spark, monkeypatch):
    rows = odd_conversations()
    assert digested(spark, rows) == plain_chat(rows)
    assert digested(spark, []) == {}
    monkeypatch.setattr(chat, "PIECE_CHARS", 200)
    monkeypatch.setattr(chat, "WINDOW_CHARS", 100)
    assert digested(spark, rows) == plain_chat(rows)


def test_long_conversations_come_in_pieces(spark):
    pieces = chat.format_conversations(table(spark, odd_conversations())).orderBy("block", "part").collect()
    of = defaultdict(list)
    for p in pieces:
        of[p.conv].append(p)
        assert len(p.spans) <= chat.PIECE_TURNS
    assert len(of[60]) >= 6 and len(of[61]) >= 3 and not any(p.whole for p in of[60] + of[61])
    assert all(len(v) == 1 and v[0].whole for k, v in of.items() if k not in (53, 60, 61))
    for p in pieces:
        # Spans follow each other; the mask holds assistants' texts only.
        assert all(a.end == b.start for a, b in zip(p.spans, p.spans[1:])) and p.spans[-1].end == len(p.text)
        assert all((s.text_start is not None) == (s.role == "assistant") for s in p.spans)
        assert not any(s.rewrites for s in p.spans)


def spans_of(spark, template, turns, learned=("assistant",)):
    rows = [(1, i, r, t) for i, (r, t) in enumerate(turns)]
    pieces = chat.format_conversations(table(spark, rows), template, learned=learned).orderBy("block", "part").collect()
    return [(p.text, s) for p in pieces for s in p.spans]


def test_other_templates_are_located_without_being_read(spark):
    turns = [("system", "be kind"), ("user", "hi"), ("assistant", "  yes  "), ("user", "hi"), ("assistant", "")]

    def lines(rows):
        return "".join(f"<|{r}|>\n{t.strip()}<|end|>\n" for r, t in rows)

    found = spans_of(spark, lines, turns)
    assert found[0][0] == lines(turns)
    assert [t[s.text_start : s.text_end] for t, s in found if s.text_start is not None] == ["yes", ""]

    def thoughtless(rows):
        """Leaves what assistants said out, but for the last turn: history changes."""
        return "".join(f"{r}:{t if r != 'assistant' or i == len(rows) - 1 else '-'};" for i, (r, t) in enumerate(rows))

    found = spans_of(spark, thoughtless, turns)
    assert [s.rewrites for _, s in found] == [False, False, False, True, False]

    def numbered(rows):
        """Looks back to the beginning."""
        return "".join(f"{i} {r} {t}\n" for i, (r, t) in enumerate(rows))

    found = spans_of(spark, numbered, [("user", "a"), ("assistant", "b")] * 20)
    assert any(s.rewrites for _, s in found)

    def shouting(rows):
        """Texts themselves choose the marks: their place isn't known."""
        return "".join(f"{r}{len(t)}:{t}!" for r, t in rows)

    found = spans_of(spark, shouting, turns)
    assert [s.text_start for _, s in found][2] is None
