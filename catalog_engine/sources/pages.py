"""Pages as bytes: files of any encoding become text.

The encoding of a page is the first of these that its bytes are valid in: that of
its byte-order mark, the one it declares in its first kilobyte, UTF-8,
windows-1252.  Bytes valid in none of them are read as windows-1252 with the
undefined ones as the replacement sign.
"""

from __future__ import annotations

import codecs
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Byte-order marks, longer ones first: that of UTF-32 starts like that of UTF-16.
MARKS = (
    (codecs.BOM_UTF8, "utf-8"),
    (codecs.BOM_UTF32_LE, "utf-32-le"),
    (codecs.BOM_UTF32_BE, "utf-32-be"),
    (codecs.BOM_UTF16_LE, "utf-16-le"),
    (codecs.BOM_UTF16_BE, "utf-16-be"),
)
#: Bytes in which a page declares its encoding.
DECLARED_IN = 1024
DECLARED = re.compile(rb"<(?:meta|\?xml)[^>]*?(?:charset|encoding)\s*=\s*[\"']?\s*([a-zA-Z0-9_.:-]+)", re.I)
#: Names under which pages mean the larger windows-1252 (HTML standard).
AS_WINDOWS = {"iso8859-1", "ascii", "latin-1"}
FALLBACK = "cp1252"


def declared(content: bytes) -> str | None:
    """The encoding that a page names, if it is a known one of text."""
    found = DECLARED.search(content[:DECLARED_IN])
    if not found:
        return None
    try:
        info = codecs.lookup(found[1].decode("ascii"))
    except LookupError:
        return None
    if not info._is_text_encoding:
        return None
    # A page whose bytes name an encoding of two bytes a letter isn't in it.
    if info.name.startswith(("utf-16", "utf-32")):
        return "utf-8"
    return FALLBACK if info.name in AS_WINDOWS else info.name


def decoded(content: bytes) -> tuple[str, str]:
    """A page's text, and the encoding it was read in."""
    for mark, name in MARKS:
        if content.startswith(mark):
            return content[len(mark) :].decode(name, "replace"), name
    for name in dict.fromkeys((declared(content), "utf-8", FALLBACK)):
        if name:
            try:
                return content.decode(name), name
            except UnicodeDecodeError:
                pass
    return content.decode(FALLBACK, "replace"), FALLBACK


DECODED = T.StructType([T.StructField(c, T.StringType()) for c in ("html", "charset")])


@F.arrow_udf(DECODED)
def _decoded(pages: pa.Array) -> pa.Array:
    found = [decoded(p.as_buffer().to_pybytes()) if p.is_valid else (None, None) for p in pages]
    html, charset = zip(*found) if found else ((), ())
    return pa.StructArray.from_arrays(
        [pa.array(html, pa.string()), pa.array(charset, pa.string())], ["html", "charset"]
    )


def decode_pages(df: DataFrame, content: str = "content", html: str = "html") -> DataFrame:
    """``df`` with the bytes in ``content`` as text in ``html``, and the encoding in ``charset``; NULL stays NULL."""
    return (
        df.withColumn("_decoded", _decoded(F.col(content)))
        .withColumns({html: F.col("_decoded.html"), "charset": F.col("_decoded.charset")})
        .drop("_decoded", content)
    )


def read_pages(spark: SparkSession, path: str, pattern: str = "*.html") -> DataFrame:
    """``path, html, charset`` of page files below a folder; files of one task go by size, not by number."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return decode_pages(files.select("path", "content"))
