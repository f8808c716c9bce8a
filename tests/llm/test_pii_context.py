"""Context words, scores and account numbers of all forms, against a plain version on all documents."""

import re

import pytest

from catalog_engine.llm import pii, queries

SF = "/root/testdata/sf0.01"


def plain_score(text, kind, start, end):
    before, after = text[max(0, start - 40) : start].lower(), text[end : end + 40].lower()
    base = {"email": 80, "ip": 60, "card": 70, "phone": 60, "iban": 80, "ssn": 30}[kind]
    words = lambda piece: re.findall(r"\w+", piece)
    if any(w.startswith(c) for w in words(f"{before} {after}") for c in pii.CONTEXT[kind]):
        base += 30
    if any(w.startswith(c) for w in words(before) for c in pii.OTHERS.get(kind, ())):
        base -= 30
    return max(0, min(100, base)) / 100


def test_spans_and_scores_equal_a_plain_version_on_all_documents(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    rows = queries.op6_pii(spark, SF).collect()
    assert len(rows) == len(docs)
    seen = set()
    for r in rows:
        text = docs[r.doc_id]
        spans = [s.split(":") for s in r.spans.split(",")] if r.spans else []
        want = [f"{plain_score(text, k, int(a), int(b)):.2f}" for k, a, b in spans]
        assert r.scores.split(",") == (want or [""])
        # Nothing that scores enough is missing.
        numbers = [(m.start(), m.end()) for m in re.finditer(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", text)]
        numbers = [(a, b) for a, b in numbers if text[a : a + 3] not in ("000", "666") and text[a] != "9"]
        got = {(int(a), int(b)) for k, a, b in spans if k == "ssn"}
        assert got == {(a, b) for a, b in numbers if plain_score(text, "ssn", a, b) >= pii.THRESHOLD}
        seen |= {k for k, _, _ in spans}
    assert seen >= set(pii.BASE)


@pytest.mark.parametrize(
    "text,score",
    [
        ("call +1 (555) 555-0100", 0.9),
        ("+1 (555) 555-0100", 0.6),
        ("invoice +1 (555) 555-0100", 0.3),
        ("version 10.2.3.4", 0.3),
        ("host 10.2.3.4", 0.9),
        ("host, release 10.2.3.4", 0.6),
        ("order 4111 1111 1111 1111", 0.4),
        ("visa 4111 1111 1111 1111", 1.0),
    ],
)
def test_words_raise_and_lower_a_score(text, score):
    ((_, _, _, got),) = pii.find(text)
    assert got == score


def test_lowered_numbers_are_not_reported_where_context_decides():
    assert [s[0] for s in pii.find("my SSN is 123-45-6789")] == ["ssn"]
    assert pii.find("social order, part 123-45-6789") == []


@pytest.mark.parametrize(
    "account",
    ["GB82 WEST 1234 5698 7654 32", "GB82-WEST-1234-5698-7654-32", "gb82west12345698765432", "gb82 west 1234 5698 7654 32", "De89 3704-0044 0532 0130 00"],
)
def test_account_numbers_of_all_forms(account):
    for text in (f"pay {account} now", f"({account})", f"{account}", f"x {account}-a"):
        assert [text[a:b] for k, a, b, _ in pii.find(text) if k == "iban"] == [account]
    wrong = account.replace("8", "9", 1)
    assert not [s for s in pii.find(f"pay {wrong} now") if s[0] == "iban"]


def test_words_are_no_account_numbers():
    for text in ("ab12 cdef ghij klmn opqr stuv", "as12 many more than four then some", "xx12 abcd " * 2000, "ab12-" * 3000):
        pii.find(text)
    assert pii.find("zz97 aaaa aaaa aaaa aaaa") == []
