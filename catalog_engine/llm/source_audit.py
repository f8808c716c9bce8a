"""How the sources of a language differ in their words: iceberg prefix refinement.

The terms that at least ``min_docs`` documents of a language hold are found
without counting all terms.  Level by level, documents are counted per byte
prefix of 4, 16, 64, ... bytes; a prefix that too few documents hold is discarded,
and only what extends a prefix that is left is counted at the next level.  A term
no longer than its level's prefixes is complete and counted as itself.

What is left of a level reaches the next as a bitmap of hashed prefixes of a
fixed size, so its size does not grow with the data.  A collision lets a prefix
be counted that need not be; it can't be kept, as no prefix has more documents
than what it extends.

Each task reads texts as bytes: words become a column of an Arrow array, are
numbered by its dictionary, and (document, prefix) pairs are sorted as numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from catalog_engine import runtime
from catalog_engine.llm.common import arrow_schema

MIN_DOCS = 10
TOP_TERMS = 10
#: Bytes of the prefixes of the first level, and how many times longer those of the next are.
FIRST_WIDTH, LONGER = 4, 4
#: Bits of the map of prefixes that are left, 16 MB.
BITMAP_BITS = 1 << 27
#: Bytes of text whose words are looked at together, at least one text.
SLICE_BYTES = 4 * 1024 * 1024
#: Numbers of a block of terms x sources.
BLOCK = 1 << 20
SCALE = 1_000_000_000

#: A-Z become a-z, a-z and all bytes of other characters stay, the rest is 0.
LOWER = np.zeros(256, np.uint8)
LOWER[0x80:] = np.arange(0x80, 0x100)
for _letter in range(ord("a"), ord("z") + 1):
    LOWER[_letter] = LOWER[_letter - 32] = _letter


def words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of a binary array, lower-cased, and the number of each word's text."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    first, last = int(offsets[0]), int(offsets[-1])
    if first == last:
        return pa.array([], pa.binary()), np.empty(0, np.int64)
    offsets = offsets - first
    low = LOWER[np.frombuffer(texts.buffers()[2], np.uint8)[first:last]]
    inside = low != 0
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    # A word ends with its text.
    heads = offsets[:-1][np.diff(offsets) > 0]
    start[heads] = inside[heads]
    at = np.flatnonzero(start)
    ends = np.cumsum(inside, dtype=np.int32)
    ends = np.concatenate([ends[at] - 1, ends[-1:]]).astype(np.int32)
    found = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(ends), pa.py_buffer(low[inside])])
    return found, np.searchsorted(offsets, at, "right") - 1


def lengths(terms: pa.Array) -> np.ndarray:
    return np.diff(np.frombuffer(terms.buffers()[1], np.int32)[terms.offset : terms.offset + len(terms) + 1])


def heads(terms: pa.Array, rows: np.ndarray, width: int) -> np.ndarray:
    """The first ``width`` bytes of some terms as rows of a matrix, shorter terms filled up with zeros."""
    offsets = np.frombuffer(terms.buffers()[1], np.int32)[terms.offset : terms.offset + len(terms) + 1]
    data = np.frombuffer(terms.buffers()[2] or b"", np.uint8)
    size = np.minimum(offsets[rows + 1] - offsets[rows], width)
    out = np.zeros((len(rows), width), np.uint8)
    place = np.arange(width)
    held = place[None, :] < size[:, None]
    out[held] = data[(offsets[rows][:, None] + place[None, :])[held]]
    return out


def hashed(lang: str, head: np.ndarray) -> np.ndarray:
    """A 64-bit hash of a language and of each row of bytes.  Zeros at the end don't count: no word holds one."""
    seed = int.from_bytes(lang.encode("utf-8", "surrogatepass")[-8:], "little") ^ (len(lang) << 56)
    h = np.full(len(head), np.uint64(seed & 0xFFFFFFFFFFFFFFFF))
    if head.shape[1] % 8:
        head = np.pad(head, ((0, 0), (0, -head.shape[1] % 8)))
    for column in np.ascontiguousarray(head).view("<u8").T:
        h = np.where(column == 0, h, _mix((h ^ column) * np.uint64(0x9E3779B97F4A7C15)))
    return _mix(h)


def hashes(lang: str, terms: pa.Array) -> np.ndarray:
    """The hash of each whole term.  Terms go by length, so that a long one doesn't widen the rows of all others."""
    size, width = lengths(terms), 8
    found = np.zeros(len(terms), np.uint64)
    while True:
        some = np.flatnonzero((size <= width) & ((size > width // 2) | (width == 8)))
        if len(some):
            found[some] = hashed(lang, heads(terms, some, width))
        if width >= size.max(initial=0):
            return found
        width *= 2


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


class Bitmap:
    """Prefixes of languages, or others of the same hash."""

    def __init__(self, data: np.ndarray):
        self.data = data

    def has(self, hashed: np.ndarray) -> np.ndarray:
        bit = (hashed % np.uint64(8 * len(self.data))).astype(np.int64)
        return (self.data[bit >> 3] >> (bit & 7)) & 1 == 1


def bitmap_of(prefixes: DataFrame, bits: int) -> Bitmap | None:
    """The bitmap of (lang, prefix) rows; None without rows.

    Bits are set by Spark in pieces of 4 KB; the driver holds ``bits`` bits at most.
    """

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, rows in _by_value(batch.column("lang")):
                found = hashes(lang, batch.column("prefix").take(pa.array(rows)))
                bit = (found % np.uint64(bits)).astype(np.int64) + 1
                yield pa.RecordBatch.from_arrays([pa.array(bit)], ["bit"])

    pieces = (
        prefixes.select("lang", "prefix")
        .mapInArrow(place, "bit long")
        .groupBy(F.bitmap_bucket_number("bit").alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))
        .toArrow()
    )
    if not pieces.num_rows:
        return None
    data = np.zeros(-(-bits // 32768) * 4096, np.uint8)
    for bucket, piece in zip(pieces.column("bucket").to_pylist(), pieces.column("bits").to_pylist()):
        data[(bucket - 1) * 4096 : bucket * 4096] = np.frombuffer(piece, np.uint8)
    return Bitmap(data[: bits // 8])


def _by_value(column: pa.Array) -> Iterator[tuple[str, np.ndarray]]:
    """Each value of a column without nulls, and its rows."""
    coded = column.dictionary_encode()
    codes = coded.indices.to_numpy()
    order = np.argsort(codes, kind="stable")
    ends = np.flatnonzero(np.diff(codes[order], append=-1)) + 1
    for start, end in zip([0, *ends[:-1].tolist()], ends.tolist()):
        yield coded.dictionary[int(codes[order[start]])].as_py(), order[start:end]


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, pa.RecordBatch]]:
    """Rows of one language whose texts have at most ``SLICE_BYTES`` bytes, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        for lang, rows in _by_value(batch.column("lang")):
            size = lengths(batch.column("text"))[rows]
            start = 0
            while start < len(rows):
                upto = np.cumsum(size[start:], dtype=np.int64)
                end = start + max(1, int(np.searchsorted(upto, SLICE_BYTES, "right")))
                yield lang, batch.take(pa.array(rows[start:end]))
                start = end


def counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct numbers, rising, and how often each is there.  Sorting takes a fraction of np.unique's time here."""
    keys = np.sort(keys)
    first = np.flatnonzero(np.diff(keys, prepend=keys[0] - 1)) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.diff(first, append=len(keys))


class _Prefixes:
    """Documents per prefix of ``width`` bytes that extends one of ``alive``, in tasks."""

    schema = "lang string, prefix binary, open boolean, n long"

    def __init__(self, width: int, alive):
        self.width, self.alive, self.out = width, alive, arrow_schema(self.schema)

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, rows in _slices(batches):
            found, doc = words(rows.column("text"))
            if not len(found):
                continue
            coded = found.dictionary_encode()
            terms, n = coded.dictionary, len(coded.dictionary)
            size = lengths(terms)
            left = np.ones(n, bool)
            if self.alive is not None:
                before = self.width // LONGER
                left = size > before
                longer = np.flatnonzero(left)
                left[longer] = self.alive.value.has(hashed(lang, heads(terms, longer, before)))
            numbers = coded.indices.to_numpy().astype(np.int64)
            held = left[numbers]
            pairs, _ = counted(doc[held] * n + numbers[held])
            # Terms of the same prefix get its number; a complete term and a prefix of its bytes are two.
            kept = np.flatnonzero(left)
            head = heads(terms, kept, self.width)
            if not len(kept):
                continue
            marked = np.concatenate([head, (size[kept] > self.width).astype(np.uint8)[:, None]], axis=1)
            rows_of = np.ascontiguousarray(marked).view(np.dtype((np.void, marked.shape[1]))).ravel()
            distinct, of_kept = np.unique(rows_of, return_inverse=True)
            prefix_of = np.zeros(n, np.int64)
            prefix_of[kept] = of_kept.ravel()
            pairs, _ = counted(pairs // n * len(distinct) + prefix_of[pairs % n])
            documents = np.bincount(pairs % len(distinct), minlength=len(distinct))
            is_open = np.frombuffer(distinct.tobytes(), np.uint8).reshape(len(distinct), -1)[:, -1] == 1
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang] * len(distinct), pa.string()),
                    pa.array([d.tobytes()[:-1].rstrip(b"\0") for d in distinct], pa.binary()),
                    pa.array(is_open),
                    pa.array(documents.astype(np.int64)),
                ],
                schema=self.out,
            )


class _Counts:
    """Occurrences of terms per language and source, in tasks."""

    schema = "lang string, term binary, source string, n long"

    def __init__(self, kept):
        self.kept, self.out = kept, arrow_schema(self.schema)

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, rows in _slices(batches):
            found, doc = words(rows.column("text"))
            if not len(found):
                continue
            coded = found.dictionary_encode()
            terms, n = coded.dictionary, len(coded.dictionary)
            left = self.kept.value.has(hashes(lang, terms))
            source = rows.column("source").dictionary_encode()
            numbers = coded.indices.to_numpy().astype(np.int64)
            held = left[numbers]
            key = source.indices.to_numpy().astype(np.int64)[doc[held]] * n + numbers[held]
            key, times = counted(key)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang] * len(key), pa.string()),
                    terms.take(pa.array(key % n)),
                    source.dictionary.take(pa.array(key // n)),
                    pa.array(times.astype(np.int64)),
                ],
                schema=self.out,
            )


def kept_terms(docs: DataFrame, min_docs: int = MIN_DOCS, bits: int = BITMAP_BITS) -> DataFrame:
    """``lang, term`` (bytes) of the terms that ``min_docs`` rows of ``docs`` (lang, text in bytes) of a language hold."""
    spark = docs.sparkSession
    kept, alive, width = None, None, FIRST_WIDTH
    while True:
        level = docs.mapInArrow(_Prefixes(width, alive), _Prefixes.schema)
        level = level.groupBy("lang", "prefix", "open").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_docs)
        level = runtime.checkpointed(level)
        complete = level.filter(~F.col("open")).select("lang", F.col("prefix").alias("term"))
        kept = complete if kept is None else kept.unionByName(complete)
        left = bitmap_of(level.filter("open"), bits)
        if left is None:
            return kept
        alive = spark.sparkContext.broadcast(left)
        width *= LONGER


def share(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * count / total), exactly, for counts up to ``total`` and below 9e15."""
    rest = count
    found = np.zeros(np.broadcast(count, total).shape, np.int64)
    for _ in range(3):
        rest = rest * 1000
        found = found * 1000 + rest // total
        rest = rest % total
    return found + 1


class _Differences:
    """Sums over a block of terms for each pair of sources, and the block's foremost terms of each source."""

    schema = "lang string, a int, b int, term binary, value long"

    def __init__(self, top: int):
        self.top, self.out = top, arrow_schema(self.schema)

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, rows in _by_value(batch.column("lang")):
                sources = len(batch.column("totals")[int(rows[0])])
                step = max(1, BLOCK // sources)
                for start in range(0, len(rows), step):
                    yield from self._block(lang, batch.take(pa.array(rows[start : start + step])))

    def _block(self, lang: str, rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        totals = np.asarray(rows.column("totals")[0].as_py(), np.int64)
        terms = rows.column("term")
        real = ~np.asarray(terms.is_null())
        entries = rows.column("entries")
        row = np.repeat(np.arange(rows.num_rows), np.diff(entries.offsets.to_numpy()))
        cells = entries.flatten()
        count = np.zeros((rows.num_rows, len(totals)), np.int64)
        count[row, cells.field("no").to_numpy()] = cells.field("n").to_numpy()
        count = count[real]
        p = share(count + 2, totals[None, :])
        lang_total = np.int64(rows.column("lang_total")[0].as_py())
        q = share(rows.column("n").to_numpy()[real] + 2, lang_total)
        terms = terms.filter(pa.array(real))
        for a in range(len(totals)):
            other = p[:, a + 1 :]
            own = p[:, a : a + 1]
            value = ((own - other) ** 2 // (own + other)).sum(axis=0)
            yield self._rows(lang, a, list(range(a + 1, len(totals))), None, value)
            high = np.flatnonzero((count[:, a] > 0) & (p[:, a] > q))
            value = (p[high, a] - q[high]) ** 2 // (p[high, a] + q[high])
            if len(high) > self.top:
                best = np.flatnonzero(value >= np.partition(value, -self.top)[-self.top])
                high, value = high[best], value[best]
            names = terms.take(pa.array(high)).to_pylist()
            best = sorted(range(len(names)), key=lambda i: (-value[i], names[i]))[: self.top]
            yield self._rows(lang, a, [None] * len(best), [names[i] for i in best], value[best])

    def _rows(self, lang, a, b, term, value) -> pa.RecordBatch:
        n = len(b)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([lang] * n, pa.string()),
                pa.array([a] * n, pa.int32()),
                pa.array(b, pa.int32()),
                pa.array(term if term is not None else [None] * n, pa.binary()),
                pa.array(np.asarray(value, np.int64)),
            ],
            schema=self.out,
        )


def audit(
    df: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    min_docs: int = MIN_DOCS,
    top: int = TOP_TERMS,
    bits: int = BITMAP_BITS,
) -> DataFrame:
    """How each source differs from the others of its language, and by which terms from the language.

    ``lang, source, part, item, value, rank``: rows of part ``pair`` name every
    other source of the language, most different first; rows of part ``term``
    name the ``top`` terms that the source has more of than its language.
    Documents are rows: repeated rows count once each, ids play no part.
    Null texts, languages and sources are empty ones; a source without terms
    is compared like the others; in a language without kept terms all
    differences are 0; equal values are ranked by item; an empty table gives
    an empty one; other columns, whatever their names, are not read.
    """
    docs = df.select(
        F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"),
        F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"),
    )
    kept = runtime.checkpointed(kept_terms(docs.select("lang", "text"), min_docs, bits))
    held = bitmap_of(kept.withColumnRenamed("term", "prefix"), bits) or Bitmap(np.zeros(1, np.uint8))
    counted = docs.mapInArrow(_Counts(df.sparkSession.sparkContext.broadcast(held)), _Counts.schema)
    # By language and term once; the sums by source need no other shuffle.
    counts = runtime.checkpointed(
        counted.repartition("lang", "term")
        .join(kept, ["lang", "term"], "left_semi")
        .groupBy("lang", "term", "source")
        .agg(F.sum("n").alias("n"))
    )
    sizes = counts.groupBy("lang", "source").agg(F.sum("n").alias("size"))
    n_terms = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("n_terms"))
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    sources = runtime.checkpointed(
        docs.select("lang", "source")
        .distinct()
        .join(sizes, ["lang", "source"], "left")
        .join(n_terms, "lang", "left")
        .select(
            "lang",
            "source",
            number.alias("no"),
            F.coalesce("size", F.lit(0)).alias("size"),
            F.coalesce("n_terms", F.lit(0)).alias("n_terms"),
        )
    )
    # Totals of a language's sources in order; 1 where nothing is counted, so that nothing divides by 0.
    ordered = F.array_sort(F.collect_list(F.struct("no", (F.col("size") + 2 * F.col("n_terms")).alias("total"))))
    langs = sources.groupBy("lang").agg(
        F.transform(ordered, lambda x: F.greatest(x["total"], F.lit(1))).alias("totals"),
        F.greatest(F.sum("size") + 2 * F.max("n_terms"), F.lit(1)).alias("lang_total"),
    )
    numbered = runtime.broadcast_if_small(sources.select("lang", "source", "no"))
    cell = F.struct("no", "n")
    by_term = (
        counts.join(numbered, ["lang", "source"])
        .groupBy("lang", "term")
        .agg(F.collect_list(cell).alias("entries"), F.sum("n").alias("n"))
    )
    # A row without a term, so that pairs of a language without kept terms are there too.
    nothing = F.filter(F.array(F.struct(F.lit(0).alias("no"), F.lit(0).cast("long").alias("n"))), lambda x: F.lit(False))
    bare = langs.select("lang", F.lit(None).cast("binary").alias("term"), nothing.alias("entries"), F.lit(0).alias("n"))
    langs = runtime.checkpointed(langs)
    found = (
        by_term.unionByName(bare)
        .join(runtime.broadcast_if_small(langs), "lang")
        .select("lang", "term", "entries", F.col("n").cast("long").alias("n"), "totals", "lang_total")
        .mapInArrow(_Differences(top), _Differences.schema)
    )
    found = runtime.checkpointed(
        found.groupBy("lang", "a", "b", "term").agg(F.sum("value").alias("value"))
    )
    one, other = numbered.select("lang", F.col("no").alias("a"), "source"), numbered.select(
        "lang", F.col("no").alias("b"), F.col("source").alias("item")
    )
    pair = found.filter("b is not null")
    both = pair.select("lang", "a", "b", "value").unionByName(
        pair.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value")
    )
    terms = found.filter("b is null").select("lang", "a", F.col("term").cast("string").alias("item"), "value")
    by_value = Window.partitionBy("lang", "a").orderBy(F.desc("value"), "item")
    ranked = both.join(other, ["lang", "b"]).select("lang", "a", F.lit("pair").alias("part"), "item", "value")
    ranked = ranked.withColumn("rank", F.row_number().over(by_value))
    foremost = terms.select("lang", "a", F.lit("term").alias("part"), "item", "value")
    foremost = foremost.withColumn("rank", F.row_number().over(by_value)).filter(F.col("rank") <= top)
    return (
        ranked.unionByName(foremost)
        .join(one, ["lang", "a"])
        .select("lang", "source", "part", "item", "value", "rank")
    )


#: The same in SQL.
SQL = r"""
WITH d AS (
    SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text, row_number() OVER () AS r
    FROM documents),
w AS (
    SELECT lang, source, r,
        translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term
    FROM d),
k AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN k USING (lang, term) GROUP BY lang, source, term),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
s AS (SELECT lang, source, sum(n) AS size FROM c GROUP BY lang, source),
g AS (
    SELECT lang, source, coalesce(size, 0) AS size, coalesce(v, 0) AS v
    FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN s USING (lang, source) LEFT JOIN v USING (lang)),
p AS (
    SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
        1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (g.size + 2 * g.v)::HUGEINT AS p
    FROM g JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
q AS (
    SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(n) + 2)) // (sum(sum(n)) OVER (PARTITION BY lang) + 2 * max(v))::HUGEINT AS q
    FROM c JOIN v USING (lang) GROUP BY lang, term),
pairs AS (
    SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
    FROM p AS a JOIN p AS b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
    GROUP BY a.lang, a.source, b.source),
terms AS (
    SELECT lang, source, term AS item, (p - q) * (p - q) // (p + q) AS value
    FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
found AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(pairs.value, 0) AS value
    FROM g AS a JOIN g AS b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
    UNION ALL SELECT lang, source, 'term', item, value FROM terms),
ranked AS (
    SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS place FROM found)
SELECT lang, source, part, item, value::BIGINT AS value, place::INTEGER AS rank
FROM ranked WHERE part = 'pair' OR place <= 10
"""
