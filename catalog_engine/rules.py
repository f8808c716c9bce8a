"""Extraction rules and the fixed values of the built-in item preset.

Everything here is an argument somewhere: pass your own rules to work on
another catalogue.  Patterns must stay within what both Java regex and RE2
understand (no look-around), so that a rule can be checked against another
engine.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column

from catalog_engine.functions import text


@dataclass(frozen=True)
class FieldRule:
    """One derived column: ``pattern`` group ``group`` of ``source``, then ``post``.

    Without a pattern the source is taken as it is.  An empty result is NULL.
    """

    name: str
    source: str
    pattern: str | None = None
    group: int = 1
    post: Callable[[Column], Column] | None = None


# --------------------------------------------------------------------------
# These must equal the reference's for results to match.
# --------------------------------------------------------------------------

URL_ID_PATTERN = r"([a-zA-Z0-9]+)[.]html$"
URL_NAME_PATTERN = r"/perfume/[^/]+/([^/]+)-[0-9]+[.]html"
URL_BRAND_PATTERN = r"/perfume/([^/]+)/"
LAUNCH_YEAR_PATTERN = r"was launched in ([0-9]{4})"
NOTE_PATTERN = r"(?i){tier} note[s]? (is|are) ([^.;]*)"

CATEGORY_SUFFIXES = (
    ("for women and men", "unisex"),
    ("for women", "women"),
    ("for men", "men"),
)

PHRASE_ALIASES = (
    ("eau de parfum", "edp"),
    ("eau de toilette", "edt"),
    ("eau de cologne", "edc"),
    ("extrait de parfum", "extrait"),
    ("parfum extrait", "extrait"),
)

TAG_PREFIXES = (
    ("accords_", "accords"),
    ("top_notes_", "top_notes"),
    ("mid_notes_", "mid_notes"),
    ("base_notes_", "base_notes"),
)

TITLE_CATEGORY_PATTERN = r"(?i)for (women and men|men|women)$"
MISSING_MARK = "N/A"
MISSING_LABEL = "—"

SEARCH_THRESHOLD = 70.0
SEARCH_LIMIT = 20
RECOMMENDATIONS = 3

# --------------------------------------------------------------------------
# The presets built from them.
# --------------------------------------------------------------------------


def one_brand_fields(segment: str) -> tuple[FieldRule, ...]:
    """Fields of an older address form, for one brand's URL segment."""
    page = rf"({segment})/(.*?)-([0-9]+)"
    return (
        FieldRule("name", "url", page, 2, text.dashes_to_spaces),
        FieldRule("brand", "url", page, 1, text.dashes_to_spaces),
        FieldRule("id", "url", page, 3),
    )


ITEM_FIELDS = (
    FieldRule("id", "url", URL_ID_PATTERN),
    FieldRule("name", "url", URL_NAME_PATTERN, post=text.dashes_to_spaces),
    FieldRule("brand", "url", URL_BRAND_PATTERN, post=text.dashes_to_spaces),
    FieldRule("release_year", "description", LAUNCH_YEAR_PATTERN),
    FieldRule("accords", "main_accords", post=text.list_text_entries),
    FieldRule("top_notes", "description", NOTE_PATTERN.format(tier="top"), 2, text.prose_list_to_csv),
    FieldRule("mid_notes", "description", NOTE_PATTERN.format(tier="middle"), 2, text.prose_list_to_csv),
    FieldRule("base_notes", "description", NOTE_PATTERN.format(tier="base"), 2, text.prose_list_to_csv),
)
