"""Personal data in texts: patterns propose, checksums confirm, context adjusts.

Patterns propose spans of six kinds.  A span that has a checksum must pass it
(Luhn for cards, mod 97 for account numbers); addresses and phone numbers are
held to their ranges.  What is left gets the base score of its kind, more when
one of the kind's words stands within ``CONTEXT_CHARS`` characters of it, and less when
one stands there that numbers of other things go by.  Spans of the kinds in
``BASE`` are always reported, with their score; the added kinds only from
``THRESHOLD`` up.

Every pattern is written so that a long run of one character class is read
once: it can't start again inside a run that it has just refused.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalog_engine.llm.common import arrow_schema, slices
from pyspark.sql.pandas.types import to_arrow_schema

BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "ssn")
KINDS = BASE + ADDED

LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(
    r"(?<![A-Za-z0-9])[A-Za-z]{2}[0-9]{2}(?:[\x20-]?[A-Za-z0-9]{4}){2,7}(?:[\x20-]?[A-Za-z0-9]{1,3})?(?![A-Za-z0-9])"
)
#: Signs of an account number by country (ISO 13616).
IBAN_LENGTH = {
    "NO": 15, "BE": 16, "DK": 18, "FI": 18, "FK": 18, "FO": 18, "GL": 18, "NL": 18, "SD": 18, "MK": 19, "SI": 19,
    "AT": 20, "BA": 20, "EE": 20, "KZ": 20, "LT": 20, "LU": 20, "MN": 20, "XK": 20, "CH": 21, "HR": 21, "LI": 21,
    "LV": 21, "BG": 22, "BH": 22, "CR": 22, "DE": 22, "GB": 22, "GE": 22, "IE": 22, "ME": 22, "RS": 22, "VA": 22,
    "AE": 23, "GI": 23, "IL": 23, "IQ": 23, "OM": 23, "SO": 23, "TL": 23, "AD": 24, "CZ": 24, "ES": 24, "MD": 24,
    "PK": 24, "RO": 24, "SA": 24, "SE": 24, "SK": 24, "TN": 24, "VG": 24, "LY": 25, "PT": 25, "ST": 25, "IS": 26,
    "TR": 26, "BI": 27, "DJ": 27, "FR": 27, "GR": 27, "IT": 27, "MC": 27, "MR": 27, "SM": 27, "AL": 28, "AZ": 28,
    "BY": 28, "CY": 28, "DO": 28, "GT": 28, "HN": 28, "HU": 28, "LB": 28, "NI": 28, "PL": 28, "SV": 28, "BR": 29,
    "EG": 29, "PS": 29, "QA": 29, "UA": 29, "JO": 30, "KW": 30, "MU": 30, "YE": 30, "MT": 31, "SC": 31, "LC": 32,
    "RU": 33,
}
SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")

SCORE = {"email": 0.8, "ip": 0.6, "card": 0.7, "phone": 0.6, "iban": 0.8, "ssn": 0.3}
CONTEXT = {
    "email": ("mail", "contact", "kontakt", "correo"),
    "ip": ("ip", "address", "host", "server", "adresse"),
    "card": ("card", "visa", "credit", "karte", "carte", "tarjeta"),
    "phone": ("phone", "call", "tel", "mobile", "fax", "telefon"),
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta"),
    "ssn": ("ssn", "social", "security", "taxpayer"),
}
CONTEXT_WORDS = {k: re.compile(r"\b(?:" + "|".join(w) + r")\w*", re.I) for k, w in CONTEXT.items()}
#: Numbers go by these words, too, that are no one's.
OTHERS = {
    "ip": ("version", "release", "chapter", "section"),
    "card": ("order", "invoice", "isbn", "serial", "ticket", "tracking"),
    "phone": ("order", "invoice", "isbn", "serial", "ticket", "tracking"),
    "iban": ("order", "serial", "ticket", "tracking"),
    "ssn": ("order", "invoice", "isbn", "serial", "ticket", "tracking", "part"),
}
OTHER_WORDS = {k: re.compile(r"\b(?:" + "|".join(w) + r")\w*", re.I) for k, w in OTHERS.items()}
CONTEXT_CHARS = 40
BOOST = 0.3
THRESHOLD = 0.5


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else (2 * n - 9 if n > 4 else 2 * n)
    return total % 10 == 0


def mod97(account: str) -> bool:
    """ISO 7064: the first four signs moved to the end, letters as 10 to 35, remainder 1."""
    moved = account[4:] + account[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def emails(text: str):
    """Leftmost non-overlapping matches, found from their ``@``: the part before it is the
    longest run of its characters, back to the last match at most."""
    cursor, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > cursor and text[start - 1] in LOCAL_CHARS:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield start, m.end()
            cursor = m.end()
            at = text.find("@", cursor)
        else:
            cursor = at + 1
            at = text.find("@", cursor)


def accounts(text: str):
    """Account numbers, in groups or not.  The pattern runs on into other words and numbers: of the
    beginnings that end with a group, the one as long as its country's numbers must pass mod 97;
    where the length is not known, the longest in capitals that passes counts.  What follows it is read again.
    """
    m = IBAN.search(text)
    while m:
        start, at = m.start(), m.start() + 1
        length = IBAN_LENGTH.get(m[0][:2].upper())
        for end in range(m.end(), start + 14, -1):
            if end < m.end() and text[end] not in " -":
                continue
            account = text[start:end].replace(" ", "").replace("-", "")
            known = len(account) == length if length else 15 <= len(account) <= 34 and account == account.upper()
            if known and mod97(account.upper()):
                yield start, end
                at = end
                break
        m = IBAN.search(text, at)


def _spans(text: str):
    if "@" in text:
        for start, end in emails(text):
            yield "email", start, end
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            yield "ip", *m.span()
    for m in CARD.finditer(text):
        if 13 <= m.end() - m.start() <= 37:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                yield "card", *m.span()
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                yield "phone", *m.span()
    for start, end in accounts(text):
        yield "iban", start, end
    for m in SSN.finditer(text):
        if m[0][:3] not in ("000", "666") and m[0][0] != "9":
            yield "ssn", *m.span()


def context_score(kind: str, before: str, after: str) -> float:
    """The score of a confirmed span between two pieces of text: 0 to 1."""
    near, score = f"{before} {after}", SCORE[kind]
    if CONTEXT_WORDS[kind].search(near):
        score += BOOST
    # What a number is called stands before it.
    if kind in OTHER_WORDS and OTHER_WORDS[kind].search(before):
        score -= BOOST
    return round(min(1.0, max(0.0, score)), 2)


def find(text: str) -> list[tuple[str, int, int, float]]:
    """Spans (kind, start, end, score) by kind as listed, then start; code points, end exclusive."""
    found = []
    for kind, start, end in _spans(text):
        score = context_score(kind, text[max(0, start - CONTEXT_CHARS) : start], text[end : end + CONTEXT_CHARS])
        if kind in BASE or score >= THRESHOLD:
            found.append((kind, start, end, score))
    return found


def mask(text: str, spans) -> str:
    """The text with every span replaced by its kind in capitals; spans that overlap become one."""
    out, cursor = [], 0
    merged = []
    for kind, start, end, score in sorted(spans, key=lambda s: (s[1], -s[2])):
        if merged and start < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], end)
        else:
            merged.append([kind, start, end])
    for kind, start, end in merged:
        out += [text[cursor:start], f"<{kind.upper()}>"]
        cursor = end
    return "".join([*out, text[cursor:]])


SPANS = "array<struct<kind:string,start:bigint,end:bigint,score:double>>"


def find_pii(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: the id and ``spans``, an array of (kind, start, end, score).

    Offsets are code points of the whole text.  A null text counts as an empty
    one and has no spans; null and repeated ids and repeated rows are kept; an
    empty table gives an empty one; other columns of ``df`` are not read.
    """
    schema = f"id {df.schema[id_col].dataType.simpleString()}, spans {SPANS}"
    out = arrow_schema(schema)

    def run(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            spans = [[dict(zip(("kind", "start", "end", "score"), s)) for s in find(t)] for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, out.field(1).type)], schema=out)

    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def mask_pii(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with personal data in ``text_col`` replaced by ``<KIND>``; null stays null, all rows and columns are kept.

    Every span that is reported is replaced, whatever its score.  Repeated rows are
    masked alike and all kept; an empty table gives an empty one.
    """
    schema, out = df.schema, to_arrow_schema(df.schema)
    at = df.columns.index(text_col)

    def run(batches):
        for batch in batches:
            texts = batch.column(at).to_pylist()
            for part in slices([t or "" for t in texts]):
                some = batch.slice(part.start, part.stop - part.start)
                masked = [None if t is None else mask(t, find(t)) for t in texts[part]]
                columns = [pa.array(masked, out.field(i).type) if i == at else some.column(i) for i in range(len(out))]
                yield pa.RecordBatch.from_arrays(columns, schema=out)

    return df.mapInArrow(run, schema)


def count_of(kind: str) -> Column:
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")


def joined(kinds: tuple[str, ...]) -> Column:
    """``kind:start:end`` of the spans of these kinds, comma-joined in their order."""
    wanted = F.filter("spans", lambda s: s["kind"].isin(*kinds))
    return F.concat_ws(
        ",",
        F.transform(wanted, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))),
    )


def scores() -> Column:
    """The scores of all spans, comma-joined in their order, with two decimals."""
    return F.concat_ws(",", F.transform("spans", lambda s: F.format_number(s["score"], 2)))
