"""Operators of training-data pipelines against plain versions, on small tables."""

import base64
import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from catalog_engine.llm import html_paths, itq, mix, multi_index, near, pieces, pii, quality, queries, tokens, warc
from tests import oracle

SF = "/root/testdata/sf0.01"
MODEL = public_tokenizers.path("piece_bpe_32k.model")
DOCS = "doc_id long, text string, source string, ids string, spans int, n_tokens int, score int, h int, bin int"
ODD = [
    (1, None, "a"),
    (2, "", None),
    (None, "Call me +1 (555) 555-0100 now", "a"),
    (3, "same words in this short text here", "b"),
    (3, "same words in this short text here", "b"),
    (4, "same words in this short text here", None),
    (5, "!!! ...", "a"),
    (6, "ünïcode \U0001f600 ▁ text\nwith  two spaces", "a"),
    (7, "word " * 30000, "b"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, "x", 1, 2, 3, 4, 5) for r in ODD], DOCS)


def texts(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


def scramble(n, seed=1):
    rnd = random.Random(seed)
    parts = ["a", "the", " ", "  ", "▁", "é", "漢", "\U0001f600", "\n", "\t", "x", "ing", "<s>", "<0x41>", "1", "-", "é"]
    return ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 12))) for _ in range(n)]


def test_token_counts_equal_the_library(spark):
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rows = texts(spark)
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in queries.op9_token_counts(spark, SF).collect()}
    want = {i: (len(t.encode()), n := len(model.encode(t)), n > 4096) for i, t in rows}
    assert got == want
    odd_texts = scramble(3000)
    assert tokens.WholeTokens(MODEL).counts(odd_texts) == [len(x) for x in model.encode(odd_texts)]


def test_token_counts_of_odd_rows(spark, odd):
    got = [(r.doc_id, r.n_bytes, r.n_tokens) for r in tokens.count_tokens(odd).collect()]
    assert len(got) == len(ODD) and (1, 0, 0) in got and (2, 0, 0) in got
    assert tokens.count_tokens(odd.limit(0)).count() == 0


def plain_viterbi(model, text):
    marked = "▁" + text.replace(" ", "▁") if text else ""
    best = [(0.0, [])] + [None] * len(marked)
    numbers = {model.text[i]: i for i in model.score}
    for end in range(1, len(marked) + 1):
        for start in range(max(0, end - 16), end):
            piece = marked[start:end]
            if piece in numbers:
                option = (best[start][0] + model.score[numbers[piece]], [*best[start][1], numbers[piece]])
            elif end - start == 1:
                unknown = [model.id_of_byte[b] for b in piece.encode()]
                option = (best[start][0] + model.unknown_score, [*best[start][1], *unknown])
            else:
                continue
            if best[end] is None or option[0] > best[end][0]:
                best[end] = option
    return best[-1][1]


def test_viterbi_equals_plain_version_and_round_trips(spark):
    model = pieces.Pieces(MODEL)
    for text in scramble(1500, 2) + [t[:300] for _, t in texts(spark)[:60]]:
        ids = model.encode(text)
        assert ids == plain_viterbi(model, text)
        assert model.decode(ids) == text.replace("▁", " ")


def test_encode_whole_table_and_decode(spark, odd):
    found = queries.op2_sentencepiece(spark, SF)
    assert found.count() == 1000 and found.filter("not round_trip").count() == 0
    back = pieces.decode(found.limit(50)).join(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id")
    assert back.count() == 50 and back.filter("decoded <> text").count() == 0
    rows = pieces.encode(odd).collect()
    assert len(rows) == len(ODD) and all(r.round_trip for r in rows)
    assert {r.doc_id: r.n_tokens for r in rows}[1] == 0
    assert pieces.encode(odd.limit(0)).count() == 0


def base_spans(text):
    patterns = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
        ("card", r"[0-9]([\x20-]?[0-9])+"),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
    )
    for kind, pattern in patterns:
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (13 <= len(digits) <= 19 and pii.luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            yield kind, *m.span()


def test_personal_data_equals_plain_patterns(spark):
    got = {r.doc_id: r for r in queries.op6_pii(spark, SF).collect()}
    for i, text in texts(spark):
        want = list(base_spans(text))
        joined = ",".join(f"{k}:{s}:{e}" for k, s, e in want)
        assert got[i].base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert got[i].n_email == sum(k == "email" for k, _, _ in want)
    rnd = random.Random(3)
    signs = [*"aA0123456789@.-+ ()é%", "1.2.3.4", "4111 1111 1111 1111", "a@b.c", "+1 (555) 555-1234"]
    for _ in range(5000):
        text = "".join(rnd.choice(signs) for _ in range(rnd.randint(0, 30)))
        assert [s[:3] for s in pii.find(text) if s[0] in pii.BASE] == list(base_spans(text))


def test_added_kinds_need_checksum_or_context(spark, odd):
    kinds = lambda t: [s[0] for s in pii.find(t)]
    assert kinds("IBAN DE89 3704 0044 0532 0130 00.") == ["iban"]
    assert kinds("IBAN DE88 3704 0044 0532 0130 00.") == []
    assert kinds("number 123-45-6789 here") == [] and kinds("my SSN is 123-45-6789") == ["ssn"]
    for run in ("a" * 100000, "1" * 100000, "@" * 100000, "1." * 50000, "a@" * 50000):
        pii.find(run)
    assert pii.mask("to a@b.co or +1 555 555 0100", pii.find("to a@b.co or +1 555 555 0100")) == "to <EMAIL> or <PHONE>"
    masked = pii.mask_pii(odd)
    assert masked.columns == odd.columns and masked.count() == len(ODD)
    assert masked.filter("doc_id is null").first().text == "Call me <PHONE> now"
    assert pii.find_pii(odd).count() == len(ODD) and pii.find_pii(odd.limit(0)).count() == 0


def test_account_numbers_before_capitals_and_numbers():
    def found(t):
        return [t[a:b] for k, a, b, _ in pii.find(t) if k == "iban"]

    spaced, whole = "BE68 5390 0754 7034", "ES9121000418450200051332"
    for text in (f"{spaced} KBC", f"pay {spaced} 2024 now", f"{spaced} KBCX Bank", f"AB12 CODE {spaced}", f"{spaced}."):
        assert found(text) == [spaced]
    assert found("ES91 2100 0418 4502 0005 1332 2024") == ["ES91 2100 0418 4502 0005 1332"]
    assert found(f"{whole} BIC CAIXESBB") == [whole]
    assert found(f"{spaced} AT61 1904 3002 3457 3201 EUR") == [spaced, "AT61 1904 3002 3457 3201"]
    assert found("BE69 5390 0754 7034 KBC") == [] and found(f"{spaced}x") == [] and found(f"{spaced}KBC") == []
    assert pii.mask(f"{spaced} KBC", pii.find(f"{spaced} KBC")) == "<IBAN> KBC"
    code = "AO06004400006729503010102"
    assert found(f"{code} REF") == [code]
    for run in ("AB12" * 30000, "AB12 " * 30000, "A" * 100000):
        pii.find(run)


def test_mix_equals_sql(spark):
    assert oracle.difference(queries.op7_mix(spark, SF), oracle.connect(SF), queries.SQL["op7_mix"]) is None


def test_mix_of_odd_rows(spark, odd):
    rows = mix.mix_report(odd).collect()
    assert len(rows) == len(ODD) and all(r.taken <= 3 * r.size for r in rows)
    taken, kept = sum(r.taken for r in rows), mix.mixed(odd)
    assert kept.columns == odd.columns
    assert sum(len(re.findall(r"[^\x20\x09-\x0d]+", r.text or "")) for r in kept.collect()) == taken
    assert mix.mix_report(odd.limit(0)).count() == 0 and mix.mixed(odd.limit(0)).count() == 0


@pytest.mark.parametrize("doc_id", [None, 7])
def test_documents_of_no_id_or_of_one_fall_into_many_bins(spark, doc_id):
    docs = spark.createDataFrame([(doc_id, f"text {i} of a few words", "a") for i in range(300)], "doc_id long, text string, source string")
    keyed = docs.select(F.floor(mix.uniform(F.col("doc_id"), F.col("text")) * mix.BINS))
    assert keyed.distinct().count() > 280


def test_archives_read_back_whole(spark, tmp_path):
    rows = [(1, "u", "<p>same</p>"), (2, "u v", "<p>same</p>"), (9, None, "<p>same</p>"), (3, "u", None), (4, "u", ""),
            (5, "u", "P*M\x18\0\0\0\0\r\n\r\n" + "x" * 300000), (None, "u", "é"), (6, "u", "one"), (6, "u", "one")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    warc.write_archives(pages, str(tmp_path / "a"), archive_bytes=100_000)
    found = warc.read_archives(spark, str(tmp_path / "a")).collect()
    got = sorted((r.key, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found)
    last = {"<p>same</p>": 9, "": 4}
    want = []
    for i, _, html in rows:
        data = (html or "").encode()
        first = last.get(html or "", i)
        want.append(("" if i is None else str(i), len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(),
                     "response" if first == i else "revisit", None if first == i else str(first)))
    assert got == sorted(want, key=lambda r: r)
    assert {r.payload.decode() for r in found if r.record_type == "response"} == {h or "" for _, _, h in rows}
    warc.write_archives(pages.limit(0), str(tmp_path / "b"))
    assert warc.read_archives(spark, str(tmp_path / "b")).count() == 0


def test_rows_without_id_under_one_address_fill_many_archives(spark, tmp_path):
    pages = spark.createDataFrame([(None, "u", f"<p>page {i}</p>" * 20) for i in range(2000)], "page_id long, url string, html string")
    warc.write_archives(pages, str(tmp_path / "a"), archive_bytes=40_000)
    assert len(list((tmp_path / "a").glob("*.txt"))) > 15
    found = warc.read_archives(spark, str(tmp_path / "a"))
    assert found.count() == 2000 and found.select("payload_digest").distinct().count() == 2000


def test_archive_starts_with_its_dictionary_and_refuses_damage():
    import struct

    records = [warc.record(str(i), "u", b"<html>%d</html>" % i * 50, None, False) for i in range(200)]
    frames = list(warc.frames(iter(records)))
    assert struct.unpack_from("<I", frames[0])[0] == warc.DICTIONARY_MAGIC and len(frames) == 201
    archive = warc.SEPARATOR.encode("latin-1").join(frames)
    assert list(warc.read_archive(archive)) == records
    with pytest.raises(Exception):
        list(warc.read_archive(archive[:-5]))


def test_main_text(spark):
    page = """<html><head><title>T</title></head><body><nav><ul><li>Home<li>More</ul></nav><header>Top</header>
    <div class="cookie-notice">We use cookies.</div><article><h1>A &amp; B</h1><p>First <b>bold</b>,<br>next&nbsp;line. It is long enough.
    <p>Second.<script>var x="</p>";</script><aside>Side</aside><div class="ad">Buy!</div><form>Mail <input></form>
    <section class="comments"><p>Nice, thanks!</p></section></article><footer>&copy; me</footer></body></html>"""
    assert html_paths.main_text(page) == "A & B\nFirst bold, next line. It is long enough.\nSecond."
    plain = "<body><div class=menu><a>x</a> <a>y</a></div><div><p>One, two, three and four.</p><p>Five, six, seven.</p></div>"
    assert html_paths.main_text(plain) == "One, two, three and four.\nFive, six, seven."
    for odd_page in ("", "<", "<p", "<p>x</", "<!-- x", "<div>" * 20000 + "x", "<b>y" * 20000, "<script>never closed"):
        html_paths.main_text(odd_page)
    rows = spark.createDataFrame([(1, "u", None, "z"), (1, "u", "<p>a b</p>", "z")], "page_id long, url string, html string, text string")
    assert sorted((r.text, r.n_chars) for r in html_paths.extract_main_text(rows).collect()) == [("", 0), ("a b", 3)]
    assert queries.op10_main_text(spark, SF).filter("text like '%©%' or n_chars = 0").count() == 0


FIRST = "The first part is long enough, as parts go, and has its marks."
SECOND = "A second part follows; it says more, in whole sentences, and ends."


@pytest.mark.parametrize("name", ["page has-sidebar", "no-sidebar", "single has-comments", "layout sidebar-right", "header-fixed"])
def test_main_text_inside_a_layout(name):
    page = f"<body><nav><a>Home</a></nav><div class='{name}'><article><p>{FIRST}</p></article><div class=sidebar>Side</div></div>"
    assert html_paths.main_text(page) == FIRST
    assert html_paths.main_text(page.replace("article>", "main>")) == FIRST
    plain = f"<body><div class='{name}'><p>{FIRST}</p><p>{SECOND}</p></div><div class=ad>Buy!</div>"
    assert html_paths.main_text(plain) == f"{FIRST}\n{SECOND}"


@pytest.mark.parametrize("name", ["discussion", "related-work", "social-impact", "search", "recommendations", "comments-on-the-method"])
def test_main_text_of_sections_named_by_their_words(name):
    page = f"<article><p>{FIRST}</p><section id='{name}'><h2 id='{name}'>Head</h2><p>{SECOND}</p></section></article>"
    assert html_paths.main_text(page) == f"{FIRST}\nHead\n{SECOND}"
    assert html_paths.main_text(page.replace(SECOND, "Few words")) == f"{FIRST}\nHead\nFew words"
    links = "".join(f"<li><a>More to read {i}</a>" for i in range(5))
    for tag in ("section", "div"):
        for mark in ("class", "id"):
            page = f"<article><p>{FIRST}</p><{tag} {mark}='{name}'><h2>More</h2><ul>{links}</ul></{tag}></article>"
            assert html_paths.main_text(page) == FIRST


def test_main_text_leaves_out_named_boilerplate():
    assert html_paths.main_text(f"<article><p>{FIRST}</p><section id=cookies><h2>Cookies</h2><p>{SECOND}</p></section></article>") == f"{FIRST}\nCookies\n{SECOND}"
    for mark in ("class=comments", "id=comments", "class=cookie-notice", "class=sidebar", "id=sidebar", "class='ad'"):
        assert html_paths.main_text(f"<article><p>{FIRST}</p><div {mark}><p>{SECOND}</p></div></article>") == FIRST
    comments = f"<div class=comments><article class=comment><p>{SECOND * 9}</p></article></div>"
    assert html_paths.main_text(f"<body><article><p>{FIRST}</p></article>{comments}") == FIRST
    related = f"<div class=related><article><p>{SECOND}</p></article></div>"
    assert html_paths.main_text(f"<body><article><p>{FIRST}</p></article>{related}") == FIRST
    assert html_paths.main_text(f"<body><form><div><article><p>{FIRST}</p></article></div></form>") == FIRST


@pytest.mark.parametrize("block", ["div class=content", "article", "div class='entry'"])
def test_main_text_of_several_articles(block):
    end = block.split()[0]
    one, two = (f"<{block}><p>{t}</p></{end}>" for t in (FIRST * 3, SECOND))
    nav, ad = "<nav><a>Home</a></nav>", "<div class=ad>Buy this, and that!</div>"
    want = f"{FIRST * 3}\n{SECOND}"
    assert html_paths.main_text(f"<body>{nav}<div>{one}{ad}{two}</div><footer>me</footer>") == want
    assert html_paths.main_text(f"<body>{nav}<div>{one}</div>{ad}<div>{two}</div>") == want
    assert html_paths.main_text(f"<body><div><h1>Title</h1>{one}<div>Buy!</div>{two}</div>") == f"Title\n{want}"


@pytest.mark.parametrize("times", [1, 5, 60, 2000])
def test_main_text_keeps_title_lead_and_end_of_long_pages(times):
    long = f"<div class='text'>{f'<p>{FIRST}</p>' * times}</div>"
    menu = "<div>" + "".join(f"<a>Go {i}</a> " for i in range(9)) + "</div>"
    page = f"<body>{menu}<h1>Title</h1><p>A lead, in short.</p>{long}<div><h2>End</h2><p>{SECOND}</p></div></body>"
    lines = html_paths.main_text(page).split("\n")
    assert lines[-times - 4 :] == ["Title", "A lead, in short.", *[FIRST] * times, "End", SECOND]
    assert times < 60 or len(lines) == times + 4


def test_quality_held_out(spark, odd):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    scored = queries.op3_quality(spark, SF)
    kept = scored.join(labels, "doc_id").filter("held_out")
    assert kept.filter("predicted = quality").count() >= 0.9 * kept.count()
    table, network = quality.fit(docs, labels)
    rows = quality.score(odd, table, network).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
    assert quality.keep_good(odd, table, network).columns == odd.columns
    table, network = quality.fit(docs.limit(0), labels.limit(0))
    assert quality.score(odd, table, network).count() == len(ODD)


def near_classes(rows):
    """Classes by comparing all pairs."""
    shingles = near.Shingles()
    sets = [near.occurrences(*shingles.weighted(t)) for _, t in rows]
    label = list(range(len(rows)))
    where = {}
    for i, s in enumerate(sets):
        for e in s.tolist():
            where.setdefault(e, []).append(i)
    pairs = {(a, b) for l in where.values() if len(l) < 300 for a in l for b in l if a < b}
    seen = {}
    links = [(seen.setdefault(t, i), i) for i, (_, t) in enumerate(rows)]
    links += [(a, b) for a, b in pairs if min(len(sets[a]), len(sets[b])) >= 0.8 * max(len(sets[a]), len(sets[b]))
              and near.similarity(sets[a], sets[b]) >= 0.8]
    for a, b in links:
        x, y = label[a], label[b]
        if x != y:
            label = [x if l == y else l for l in label]
    least = {}
    for l, (i, _) in zip(label, rows):
        least[l] = min(least.get(l, i), i)
    return {i: least[l] for l, (i, _) in zip(label, rows)}


def test_near_duplicates_equal_all_pairs(spark):
    got = {r.doc_id: r.class_id for r in queries.op5_dart_minhash(spark, SF).collect()}
    assert got == near_classes(texts(spark))


def test_near_duplicates_in_split_buckets(spark, monkeypatch):
    """Buckets larger than a block, with members that are not similar to the smallest id."""
    rnd = random.Random(4)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(60):
        words = list(base)
        for at in rnd.sample(range(120), rnd.choice([0, 1, 2, 3, 4, 5])):
            words[at] = f"x{rnd.randint(0, 10**6)}"
        rows.append((i, " ".join(words)))
    monkeypatch.setattr(near, "BLOCK", 8)
    got = near.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: r.class_id for r in got.collect()} == near_classes(rows)


def test_dart_signature_agreement_is_weighted_similarity():
    rng = np.random.default_rng(1)
    elements = rng.integers(0, 2**63, 300).astype(np.uint64)
    a, b = rng.integers(1, 6, 300).astype(float), rng.integers(1, 6, 300).astype(float)
    signs = near.signatures([(elements, a), (elements[::-1].copy(), b[::-1].copy())], k=2000)
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert abs((signs[0] == signs[1]).mean() - want) < 0.05


def test_near_duplicates_of_odd_rows(spark, odd):
    rows = near.near_duplicates(odd).collect()
    assert len(rows) == len(ODD)
    by = {r.doc_id: r.class_id for r in rows}
    assert by[None] is None and by[3] == by[4] == 3 and by[1] == by[2] == 1 and by[5] == 5
    kept = near.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 3, 5, 6, 7]
    assert near.near_duplicates(odd.limit(0)).count() == 0


def vectors(spark, extra=()):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 24)).astype(np.float32)
    x[100:140] = x[100] + 0.05 * rng.normal(size=(40, 24))
    x[200:230] = x[200]
    x[300:340] = x[300] + rng.normal(size=(40, 24)) * 0.33
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + list(extra)
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>"), x.astype(np.float64)


EXTRA = [(900, None), (901, []), (902, [0.0] * 24), (903, [float("nan")] * 24), (904, [None] * 24), (905, [1.0, 2.0]), (None, [1.0] * 24)]


def test_keeping_one_beside_columns_of_any_name(spark):
    clashing = ["__id", "kept_id", "KEPT_ID_", "id", "kept", "class_id", "digest", "bucket", "count"]
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "A b c d e f"), (2, "x"), (None, "x")], "doc_id long, text string")
    docs = docs.withColumns({c: F.lit(c) for c in clashing})
    kept = near.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text) for r in kept.collect()) == [(0, "x"), (1, "a b c d e f"), (2, "x")]


A_TEXT, B_TEXT = "these words are the text that is called A", "and quite other words are the one called B"


@pytest.mark.parametrize(
    "rows,kept,classes",
    [
        # An exact copy goes, and the other text of its id stays.
        ([(3, A_TEXT), (5, A_TEXT), (5, B_TEXT)], [(3, A_TEXT), (5, B_TEXT)], [(3, 3), (5, 3), (5, 5)]),
        # Two texts of one id link nothing.
        ([(1, A_TEXT), (2, A_TEXT), (2, B_TEXT), (4, B_TEXT)], [(1, A_TEXT), (2, B_TEXT)], [(1, 1), (2, 1), (2, 2), (4, 2)]),
        ([(7, A_TEXT), (7, A_TEXT.upper())], [(7, None)], [(7, 7), (7, 7)]),
        ([(3, A_TEXT)] * 3 + [(None, A_TEXT)] * 2, [(3, A_TEXT), (None, A_TEXT), (None, A_TEXT)], [(3, 3)] * 3 + [(None, None)] * 2),
    ],
)
def test_a_document_is_an_id_and_a_text(spark, rows, kept, classes):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("digest", F.lit("d"))
    found = near.keep_one(df)
    assert found.columns == df.columns
    found = [(r.doc_id, r.text) for r in found.collect()]
    if kept == [(7, None)]:
        assert len(found) == 1
    else:
        assert sorted(found, key=repr) == sorted(kept, key=repr)
    got = sorted(((r.doc_id, r.class_id) for r in near.near_duplicates(df).collect()), key=repr)
    assert got == sorted(classes, key=repr)


def test_the_text_that_stays_does_not_depend_on_order(spark):
    rows = [(7, f"these are the words of text {i}") for i in range(6)] + [(8, "x"), (None, "y")]
    rows += [(9, " ".join(f"word{j}" for j in range(60)) + f" end{i}") for i in range(4)]
    kept = [
        sorted((r.doc_id or 0, r.text) for r in near.keep_one(spark.createDataFrame(some, "doc_id long, text string").coalesce(1)).collect())
        for some in (rows, rows[::-1])
    ]
    assert kept[0] == kept[1] and [i for i, _ in kept[0]] == [0, *[7] * 6, 8, 9]


def test_near_vectors_equal_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(itq, "BLOCK", 16)
    df, x = vectors(spark, EXTRA)
    got = {r.vec_id: r for r in itq.near_vectors(df).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    linked = (unit @ unit.T >= 0.9) & ~np.eye(len(x), dtype=bool)
    found = sum(got[i].n_links for i in range(len(x)))
    assert all(got[i].n_links <= linked[i].sum() for i in range(len(x)))
    assert found >= 0.98 * linked.sum() and linked.sum() > 2000
    assert all(got[i].component_id == 100 for i in range(100, 140)) and all(got[i].n_links == 29 for i in range(200, 230))
    assert all(got[i].n_links == 0 and got[i].component_id == i for i in (900, 901, 902, 903, 904, 905))
    assert len(got) == 407 and itq.near_vectors(df.limit(0)).count() == 0


def test_nearest_recall_and_scores(spark, monkeypatch):
    monkeypatch.setattr(multi_index, "BLOCK", 16)
    df, x = vectors(spark, EXTRA)
    rows = multi_index.nearest(df, df.filter("vec_id % 10 = 0 or vec_id = 905")).collect()
    hits = 0
    for query in range(0, 400, 10):
        gap = np.sqrt(((x - x[query]) ** 2).sum(1))
        gap[query] = np.inf
        answers = sorted((r["rank"], r.vec_id, r.score) for r in rows if r.query_id == query)
        assert [a[0] for a in answers] == list(range(1, 11))
        assert all(abs(gap[i] - s) < 1e-9 for _, i, s in answers)
        assert [(s, i) for _, i, s in answers] == sorted((s, i) for _, i, s in answers)
        hits += len({i for _, i, _ in answers} & set(np.lexsort((np.arange(400), gap))[:10].tolist()))
    assert hits >= 0.9 * 400
    assert not [r for r in rows if r.query_id == 905]
    assert multi_index.nearest(df.limit(0), df.limit(0)).count() == 0


def test_index_order_visits_every_cell_by_distance():
    x = np.random.default_rng(3).normal(size=(500, 8))
    index = multi_index.Index(x, 5000, 10)
    order = list(index.order(x[0]))
    first = multi_index.distances(x[:1, :4], index.books[0])[0]
    second = multi_index.distances(x[:1, 4:], index.books[1])[0]
    sums = [first[c // index.k] + second[c % index.k] for c in order]
    assert sorted(order) == list(range(index.k**2)) and sums == sorted(sums)


def test_recall_on_given_vectors(spark):
    vecs = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas()
    x, ids = np.stack(vecs.embedding).astype(np.float64), vecs.vec_id.to_numpy()
    rows = queries.op1_multi_index(spark, SF).collect()
    hits = 0
    for query in ids[ids % 100 == 0]:
        gap = ((x - x[ids == query]) ** 2).sum(1)
        gap[ids == query] = np.inf
        hits += len({r.vec_id for r in rows if r.query_id == query} & set(ids[np.lexsort((ids, gap))[:10]].tolist()))
    assert hits >= 0.9 * len(rows)


def test_pipeline(spark, odd):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    n, before = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, before, SF)
        if name != "sentencepiece":
            assert after.columns == n
        if name == "near_duplicates":
            classes = near_classes([(r.doc_id, r.text) for r in before.select("doc_id", "text").collect()])
            assert sorted(r.doc_id for r in after.collect()) == sorted(set(classes.values()))
        if name == "personal_data":
            assert after.count() == before.count()
            assert not [r for r in after.collect() if pii.find(r.text) and any(s[0] in pii.BASE for s in pii.find(r.text))]
        if name == "mix":
            assert after.count() > 0
        if name == "sentencepiece":
            model = pieces.Pieces(MODEL)
            want = sorted((r.doc_id, model.encode(r.text)) for r in before.collect())
            assert sorted((r.doc_id, list(r.ids)) for r in after.collect()) == want
        before = spark.createDataFrame(after.collect(), after.schema) if name != "sentencepiece" else after


def all_pairs_classes(rows):
    """Classes by comparing all pairs, whatever the number of documents that share a run of words."""
    shingles = near.Shingles()
    sets = [near.occurrences(*shingles.weighted(t)) for _, t in rows]
    label = list(range(len(rows)))

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    for j, (_, text) in enumerate(rows):
        for i in range(j):
            if top(i) == top(j):
                continue
            least, most = sorted((len(sets[i]), len(sets[j])))
            if text == rows[i][1] or least and least >= 0.8 * most and near.similarity(sets[i], sets[j]) >= 0.8:
                label[top(j)] = top(i)
    return {i: min(rows[k][0] for k in range(len(rows)) if top(k) == top(at)) for at, (i, _) in enumerate(rows)}


def test_run_of_the_pipeline_equals_a_plain_chain(spark, tmp_path):
    """All stages, each written and read again, against plain versions on a table with a large group of near copies."""
    import corpus_pipeline
    import pandas as pd

    labels = spark.read.parquet(f"{SF}/labels.parquet")
    given = spark.read.parquet(f"{SF}/documents.parquet").filter("char_length(text) < 900").orderBy("doc_id").limit(160)
    good = given.join(labels.filter("quality = 1"), "doc_id", "left_semi").filter("char_length(text) > 500")
    base, rnd = good.orderBy("doc_id").first(), random.Random(5)
    rows = [tuple(r) for r in given.collect()]
    for i in range(320):
        words = base.text.split(" ")
        words[rnd.randrange(len(words))] = f"other{i}"
        text = " ".join([*words, "mail", f"reader{i}@example.org"][: len(words) + 2 * (i % 2)])
        rows.append((10**6 + i, text, base.lang, base.source, len(text)))
    documents = spark.createDataFrame(rows, given.schema)
    documents.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    table, network = quality.fit(documents, labels)
    score = {r.doc_id: r.score for r in quality.score(documents, table, network).collect()}
    kept = [r for r in rows if score[r[0]] >= 0.3]
    assert sum(r[0] >= 10**6 for r in kept) >= 300 and len(kept) < len(rows)
    least = set(all_pairs_classes([r[:2] for r in kept]).values())
    assert len(least) < len(kept) - 300
    masked = [(i, pii.mask(t, pii.find(t)), lang, source) for i, t, lang, source, _ in kept if i in least]
    con = oracle.duckdb.connect()
    con.register("documents", pd.DataFrame(masked, columns=["doc_id", "text", "lang", "source"]))
    mixed = con.execute(f"SELECT doc_id, size, taken FROM ({mix.SQL})").fetchall()
    times = {i: taken // size if size else 0 for i, size, taken in mixed}
    model, want = pieces.Pieces(MODEL), []
    for i, text, lang, source in masked:
        want += times[i] * [(i, lang, source, len(text), plain_viterbi(model, text))]
    assert len(want) > len(masked)
    assert sorted((r.doc_id, r.lang, r.source, r.n_chars, list(r.ids)) for r in got) == sorted(want)
