"""String column expressions (operators E1-E7, E9-E11, E14, E15, U1, Q4).

All of them are built-in Spark expressions: nothing here leaves the JVM, and
none of them throws on bad data under ANSI mode.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# A word character is a letter, a number or "_" in any script.  Java's own \w
# is ASCII only and its (?U) form adds combining marks, so it is spelled out.
WORD = r"[\p{L}\p{N}_]"

# What stands for a missing value in scraped records.
MISSING_MARKS = ("None", "N/A")

# What a list text has around its entries and between them.
LIST_ENDS = r"""^\[?['"]?|['"]?\]?$"""
LIST_BETWEEN = r"""['"],\s*['"]"""


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def blank_to_null(c: Column | str) -> Column:
    return F.nullif(_col(c), F.lit(""))


def extract(c: Column | str, pattern: str, group: int = 1) -> Column:
    """First match's group, NULL when nothing matched."""
    return blank_to_null(F.regexp_extract(_col(c), pattern, group))


def dashes_to_spaces(c: Column | str) -> Column:
    """URL slug to words."""
    return F.translate(_col(c), "-", " ")


def list_text_to_csv(c: Column | str) -> Column:
    """``['a', 'b']`` to ``a, b``: brackets and quotes go, spaces stay."""
    return F.translate(_col(c), "[]'", "")


def list_text_entries(c: Column | str) -> Column:
    """``['a', "lily's"]`` to ``a, lily's``: only the list's own brackets and quotes go.

    Missing marks and empty lists are NULL.
    """
    inner = F.regexp_replace(_col(c), LIST_ENDS, "")
    return blank_to_null(missing_to_null(F.regexp_replace(inner, LIST_BETWEEN, ", ")))


def missing_to_null(c: Column | str) -> Column:
    """The marks that scraped records use for a missing value, as NULL."""
    c = _col(c)
    return F.when(~c.isin(*MISSING_MARKS), c)


def list_text_to_array(c: Column | str) -> Column:
    """Legacy list text to an array; missing marks become NULL."""
    c = _col(c)
    items = F.filter(
        F.transform(F.split(list_text_to_csv(c), ","), lambda x: F.trim(x)), lambda x: x != ""
    )
    return F.when(~c.isin(*MISSING_MARKS), items)


def prose_list_to_csv(c: Column | str) -> Column:
    """``Rose and Musk`` to ``rose, musk``; words that start with "and" survive (E5)."""
    return F.lower(F.regexp_replace(_col(c), r" and\b", ","))


def suffix_category(c: Column | str, rules: Iterable[tuple[str, str]], match: str = "suffix") -> Column:
    """First rule whose text ends the value wins, else NULL.

    ``match="contains"`` looks anywhere in the value, ignoring case.
    """
    c = _col(c)
    hit = {
        "suffix": lambda needle: c.endswith(needle),
        "contains": lambda needle: F.lower(c).contains(needle.lower()),
    }[match]
    return F.coalesce(*[F.when(hit(needle), F.lit(label)) for needle, label in rules])


def to_int(c: Column | str) -> Column:
    """Thousands separators removed; anything else that is no integer is NULL."""
    return F.regexp_replace(_col(c), ",", "").try_cast("int")


def to_decimal(c: Column | str, kind: str = "decimal(10,2)") -> Column:
    return _col(c).try_cast(kind)


def to_key(c: Column | str) -> Column:
    """Key text to long, NULL when it is not numeric."""
    return _col(c).try_cast("bigint")


def int_lead(c: Column | str) -> Column:
    """An int as bigint that is never NULL; NULL is the smallest."""
    return F.coalesce(_col(c).cast("bigint"), F.lit(-(1 << 40)))


def text_lead(c: Column | str) -> Column:
    """The first 7 bytes as bigint, in the order of texts; NULL is the smallest."""
    start = F.rpad(F.hex(F.substring(_col(c).cast("binary"), 1, 7)), 14, "0")
    return F.coalesce(F.conv(start, 16, 10).cast("bigint"), F.lit(-1))


def normalize_aliases(c: Column | str, aliases: Sequence[tuple[str, str]]) -> Column:
    """Lower-case, then replace whole phrases in the order given."""
    low = done = F.lower(_col(c))
    for phrase, short in aliases:
        done = F.regexp_replace(done, rf"(?<!{WORD}){java_quote(phrase)}(?!{WORD})", _java_replacement(short))
    # A text without any of the phrases passes the cheap test only.
    held = [low.contains(phrase) for phrase, _ in aliases]
    return F.when(reduce(or_, held), done).otherwise(low) if held else low


def normalize_term(term: str, aliases: Sequence[tuple[str, str]]) -> str:
    """The same normalisation for one search term held by the driver."""
    term = term.strip().lower()
    for phrase, short in aliases:
        term = re.sub(rf"\b{re.escape(phrase)}\b", lambda _: short, term)
    return term


def java_quote(s: str) -> str:
    """A literal inside a Java pattern."""
    return "\\Q" + s.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def _java_replacement(s: str) -> str:
    return s.replace("\\", "\\\\").replace("$", "\\$")


def lines_to_array(c: Column | str) -> Column:
    """Pasted lines to a list without blanks."""
    lines = F.transform(F.split(_col(c), "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    return F.filter(lines, lambda x: x != "")


def or_label(c: Column | str, label: str) -> Column:
    """Display default for NULL and empty text."""
    return F.coalesce(blank_to_null(c), F.lit(label))


def display_label(*cols: Column | str, sep: str = " — ") -> Column:
    """``name — brand``."""
    return F.concat_ws(sep, *[_col(c) for c in cols])


def tag_bag(fields: Iterable[tuple[str, Column | str]]) -> Column:
    """Prefixed bag of words from comma lists.

    Every entry of every non-empty list becomes ``<prefix><entry_with_underscores>``;
    NULL and empty lists add nothing, and with no lists at all the bag is ``''``.
    """
    def tags(prefix: str, c: Column) -> Column:
        words = F.transform(
            F.split(c, ","), lambda x: F.concat(F.lit(prefix), F.translate(F.trim(x), " ", "_"))
        )
        return F.when(c != "", F.array_join(words, " "))

    parts = [tags(prefix, _col(c)) for prefix, c in fields]
    return F.trim(F.concat_ws(" ", *parts))


def field_ok(c: Column | str, kind: str = "string", missing: str = "N/A") -> Column:
    """Not NULL, not the missing mark, not an empty list (Q4)."""
    c = _col(c)
    good = F.size(c) > 0 if kind.startswith("array") else c.cast("string") != missing
    return F.coalesce(good, F.lit(False))
