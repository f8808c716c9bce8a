"""Near-duplicate documents by DartMinHash.

A document is the weighted set of its runs of five words, each weighing as
often as it occurs.  Darts fall on the plane (element, weight, rank): for the weights
from 2**v - 1 to 2**(v + 1) - 1 of an element they arrive along the rank as a
Poisson process of rate 2**v, drawn from hashes of the element, so that all
documents see the same darts.  A dart hits a document that has more of the
element than the dart's weight.  Each dart belongs to one of ``K`` coordinates, and
a coordinate keeps its earliest hit; two documents agree in a coordinate
with probability sum(min) / sum(max) of their weights.  Ranks up to
K (ln K + 2) / total weight nearly always fill all coordinates; where they don't,
the limit is doubled.

``BANDS`` bands of ``ROWS`` coordinates propose pairs.  Every document is
compared, on its whole set, with the smallest id that it shares a band with;
buckets that still hold several classes after that are compared within, pair by
pair, until all pairs that meet in a bucket are known to be in one class or to be different.
Copies of one text are one document throughout.
"""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalog_engine import runtime
from catalog_engine.llm.blocks import Forest, gathered, groups, paired
from catalog_engine.llm.common import arrow_schema, slices, unused_name
from catalog_engine.llm.components import components

SHINGLE = 5
THRESHOLD = 0.8
BANDS = 24
ROWS = 5
K = BANDS * ROWS
#: Rows of a bucket that are compared in one block.
BLOCK = 512
KNOWN_WORDS = 400_000
#: Characters of texts whose signatures are computed together.
BATCH_CHARS = 1 << 20
WORD = re.compile(r"\w+")


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the result depends on all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


GOLDEN = 0x9E3779B97F4A7C15
STEP = np.uint64(0xD1B54A32D192ED03)


def _salt(n: int) -> np.uint64:
    return np.uint64((n * GOLDEN) & 0xFFFFFFFFFFFFFFFF)


def _unit(x: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) from the upper bits of hashes."""
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)


class Shingles:
    """Weighted sets of word runs."""

    def __init__(self, size: int = SHINGLE):
        self.size, self.known = size, {}

    def _words(self, text: str) -> np.ndarray:
        words = WORD.findall(text.lower())
        known = self.known
        found = list(map(known.get, words))
        if None in found:
            if len(known) > KNOWN_WORDS:
                known.clear()
            for i, number in enumerate(found):
                if number is None:
                    word = words[i]
                    found[i] = number = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
                    if len(word) <= 64:
                        known[word] = number
        return np.array(found, np.uint64)

    def weighted(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the distinct runs and how often each occurs.  A text of fewer words is one run; none has none."""
        words = self._words(text)
        if not len(words):
            return words, np.empty(0)
        size = min(self.size, len(words))
        runs = words[: len(words) - size + 1].copy()
        for i in range(1, size):
            runs = runs * np.uint64(0x100000001B3) + words[i : len(words) - size + 1 + i]
        elements, counts = np.unique(mixed(runs + _salt(size)), return_counts=True)
        return elements, counts.astype(np.float64)


def occurrences(elements: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The weighted set as a plain one: an element that occurs n times gives n members."""
    repeats = counts.astype(np.int64)
    first = np.cumsum(repeats) - repeats
    turn = np.arange(repeats.sum()) - np.repeat(first, repeats)
    members = mixed(np.repeat(elements, repeats) + turn.astype(np.uint64) * STEP)
    return np.unique((members >> np.uint64(32)).astype(np.uint32))


def signatures(sets: list[tuple[np.ndarray, np.ndarray]], k: int = K) -> np.ndarray:
    """For each weighted set (elements, positive weights) the dart of smallest rank in each of ``k`` coordinates.

    The sets share the arithmetic, not the darts: a row is what its set alone would give.
    """
    earliest = np.zeros((len(sets), k), np.uint64)
    todo, limits = np.arange(len(sets)), np.array([k * (math.log(k) + 2) / w.sum() for _, w in sets])
    while len(todo):
        elements = np.concatenate([sets[i][0] for i in todo])
        weights = np.concatenate([sets[i][1] for i in todo])
        owner = np.repeat(np.arange(len(todo)), [len(sets[i][0]) for i in todo])
        limit = limits[todo][owner]
        owners, ranks, darts = [], [], []
        for v in range(int(math.log2(weights.max() + 1)) + 1):
            low, rate = 2.0**v - 1, 2.0**v
            here = np.flatnonzero(weights > low)
            state, rank = mixed(elements[here] + _salt(v + 1)), np.zeros(len(here))
            while len(here):
                state = mixed(state + STEP)
                rank -= np.log(_unit(state)) / rate
                inside = np.flatnonzero(rank < limit[here])
                here, state, rank = here[inside], state[inside], rank[inside]
                hit = np.flatnonzero(low + rate * _unit(mixed(state + _salt(101))) < weights[here]) if v else slice(None)
                owners.append(owner[here[hit]])
                ranks.append(rank[hit])
                darts.append(state[hit])
        owner, rank, dart = np.concatenate(owners), np.concatenate(ranks), mixed(np.concatenate(darts) + _salt(102))
        order = np.argsort(-rank, kind="stable")
        place = (owner * k + (dart % np.uint64(k)).astype(np.int64))[order]
        found, filled = np.zeros(len(todo) * k, np.uint64), np.zeros(len(todo) * k, bool)
        found[place] = dart[order]  # the last one written is the one of smallest rank
        filled[place] = True
        full = filled.reshape(-1, k).all(axis=1)
        earliest[todo[full]] = found.reshape(-1, k)[full]
        limits[todo] *= 2
        todo = todo[~full]
    return earliest


def bands(earliest: np.ndarray, count: int = BANDS) -> np.ndarray:
    """A hash for each band of each signature, different for different bands."""
    rows = earliest.reshape(len(earliest), count, earliest.shape[1] // count)
    found = np.repeat(mixed(np.arange(1, count + 1, dtype=np.uint64) * STEP)[None], len(earliest), axis=0)
    for i in range(rows.shape[2]):
        found = mixed(found * np.uint64(0x100000001B3) + rows[:, :, i])
    return found.view(np.int64)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """sum(min) / sum(max) of two weighted sets, given as ``occurrences``."""
    if not len(a) or not len(b):
        return 0.0
    both = np.concatenate([a, b])
    both.sort()
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return common / (len(both) - common)


def digest_of(text_col: str) -> Column:
    """16 bytes that stand for a text; null is the empty text."""
    return F.unhex(F.substring(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256), 1, 32))


def _texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, t, digest`` of all rows."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return df.select(F.col(id_col).cast("long").alias("id"), text.alias("t"), digest_of(text_col).alias("digest"))


def _banded(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, digest, bands`` of all rows, written down."""
    schema = "id bigint, digest binary, bands array<bigint>"
    out = arrow_schema(schema)

    def run(batches):
        shingles = Shingles()
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for part in slices(texts, BATCH_CHARS):
                sets = [shingles.weighted(t) for t in texts[part]]
                known = [i for i, (elements, _) in enumerate(sets) if len(elements)]
                found = [[]] * len(sets)
                for i, row in zip(known, bands(signatures([sets[i] for i in known]))):
                    found[i] = row
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(part.start, len(sets)),
                        batch.column(2).slice(part.start, len(sets)),
                        pa.array(found, out.field(2).type),
                    ],
                    schema=out,
                )

    return runtime.checkpointed(_texts(df, id_col, text_col).mapInArrow(run, schema))


def _sets(df: DataFrame, nodes: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, members`` of the texts in ``nodes`` (id, rep, digest): their sets, from one document's whole text each."""
    schema = "digest binary, members binary"
    out = arrow_schema(schema)

    def run(batches):
        shingles = Shingles()
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for part in slices(texts):
                sets = [occurrences(*shingles.weighted(t)).tobytes() for t in texts[part]]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(2).slice(part.start, len(sets)), pa.array(sets, pa.binary())], schema=out
                )

    wanted = nodes.select(F.col("rep").alias("id"), "digest")
    rows = _texts(df, id_col, text_col).join(wanted, ["id", "digest"], "left_semi").select("id", "t", "digest")
    # A document that is there several times has one set.
    sets = rows.mapInArrow(run, schema).groupBy("digest").agg(F.first("members").alias("members"))
    return sets.join(nodes.select("id", "digest"), "digest").select("id", "members")


def _verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The rows of ``pairs`` (a, b) whose sets are similar enough."""
    schema = "a bigint, b bigint"
    out = arrow_schema(schema)

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                some = batch.slice(start, 256)
                good = [
                    similarity(np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)) >= threshold
                    for x, y in zip(some.column(2).to_pylist(), some.column(3).to_pylist())
                ]
                keep = pa.array(good, pa.bool_())
                yield pa.RecordBatch.from_arrays([some.column(i).filter(keep) for i in (0, 1)], schema=out)

    one = sets.select(F.col("id").alias("a"), F.col("members").alias("x"))
    other = sets.select(F.col("id").alias("b"), F.col("members").alias("y"))
    return pairs.join(one, "a").join(other, "b").select("a", "b", "x", "y").mapInArrow(run, schema)


def _within(rows: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) between the classes of a bucket: rows are (bucket, id, label, members)."""
    keys = ["bucket", "p", "q"]
    dealt = paired(rows, ["bucket"], "id", BLOCK)
    dealt = gathered(dealt.select(*keys, "s", "id", "label", "members"), keys)
    schema = "a bigint, b bigint"
    out = arrow_schema(schema)

    def links(group):
        p, q = group.column(1)[0].as_py(), group.column(2)[0].as_py()
        side, labels = group.column(3).to_numpy(), group.column(5).to_numpy()
        sets = [np.frombuffer(m, np.uint32) for m in group.column(6).to_pylist()]
        sizes = np.array([len(m) for m in sets])
        forest = Forest(labels)
        everyone = np.arange(len(sets))
        for i in everyone:
            if p == q:
                among = everyone[:i]
            else:
                among = everyone[side == q] if side[i] == p else everyone[:0]
            least, most = np.minimum(sizes[i], sizes[among]), np.maximum(sizes[i], sizes[among])
            among = among[least >= threshold * most]
            for j in forest.apart(i, among):
                if not forest.together(i, j) and similarity(sets[i], sets[j]) >= threshold:
                    forest.join(i, j)
                    yield labels[i], labels[j]

    def run(batches):
        for group in groups(batches, 3):
            found = list(links(group))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], schema=out)

    return dealt.mapInArrow(run, schema)


def near_duplicates(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD
) -> DataFrame:
    """One row per row of ``df``: the id, ``class_id`` and ``kept``.

    Documents are linked when their texts are equal or their weighted sets of
    five-word runs (lower case) are at least ``threshold`` similar; a class is what
    links connect, named by its smallest id; of its documents that of the smallest
    id is kept, of several texts under that id that of the smallest digest.  Null
    texts are empty ones; texts without words are linked with equal texts only; texts
    of under five words are one run.  Rows without an id take part in nothing:
    class null, kept.  An id that repeats with other texts stands for as many
    documents, which it does not link; ids must be whole numbers, or text that is
    one.  Empty tables give empty ones; other columns are not read.
    """
    return _classes(df, id_col, text_col, threshold).drop("digest")


def _classes(df: DataFrame, id_col: str, text_col: str, threshold: float) -> DataFrame:
    """``near_duplicates`` with the ``digest`` of each row's text."""
    banded = _banded(df.filter(F.col(id_col).isNotNull()), id_col, text_col)
    # A text is a node, whatever documents have it.
    texts = banded.groupBy("digest").agg(F.min("id").alias("rep"), F.first("bands").alias("bands"))
    texts = runtime.checkpointed(texts.withColumn("id", F.monotonically_increasing_id()))
    every = texts.select("id", F.explode("bands").alias("bucket")).distinct()
    shared = (
        every.groupBy("bucket")
        .agg(F.min("id").alias("leader"), F.max("id").alias("last"))
        .filter(F.col("leader") < F.col("last"))
        .select("bucket", "leader")
    )
    members = runtime.checkpointed(every.join(shared, "bucket"))
    nodes = texts.select("id", "rep", "digest").join(members.select("id").distinct(), "id", "left_semi")
    sets = runtime.checkpointed(_sets(df, nodes, id_col, text_col))

    first = members.groupBy(F.col("id").alias("a")).agg(F.min("leader").alias("b")).filter(F.col("a") != F.col("b"))
    links = runtime.checkpointed(_verified(first, sets, threshold))
    labels = components(links)

    labelled = members.join(labels, "id", "left").select("bucket", "id", F.coalesce("component", "id").alias("label"))
    labelled = runtime.checkpointed(labelled)
    several = (
        labelled.groupBy("bucket")
        .agg(F.min("label").alias("least"), F.max("label").alias("most"))
        .filter(F.col("least") < F.col("most"))
        .select("bucket")
    )
    rest = labelled.join(several, "bucket", "left_semi").join(sets, "id")
    more = runtime.checkpointed(_within(rest.select("bucket", "id", "label", "members"), threshold))
    classes = runtime.checkpointed(components(links.unionByName(more)))

    # Most texts are alone; the others get the least id, and digest, of their class.
    linked = texts.select("id", "rep", "digest").join(classes, "id")
    chosen = linked.groupBy("component").agg(F.min(F.struct("rep", "digest")).alias("chosen"))
    chosen = linked.select("digest", "component").join(chosen, "component").select("digest", "chosen")
    by_digest = texts.select("digest", "rep").join(chosen, "digest", "left").select(
        "digest", F.coalesce("chosen", F.struct("rep", "digest")).alias("chosen")
    )
    found = banded.select("id", "digest").join(by_digest, "digest").select(
        F.col("id").alias(id_col),
        F.col("chosen.rep").alias("class_id"),
        ((F.col("id") == F.col("chosen.rep")) & (F.col("digest") == F.col("chosen.digest"))).alias("kept"),
        "digest",
    )
    nameless = df.filter(F.col(id_col).isNull()).select(
        F.col(id_col).cast("long").alias(id_col),
        F.lit(None).cast("long").alias("class_id"),
        F.lit(True).alias("kept"),
        F.lit(None).cast("binary").alias("digest"),
    )
    return found.unionByName(nameless)


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``df`` that stay when of each class of near-duplicates one document is kept; same columns.

    A document is an id and a text: other texts of an id are documents of their own.
    Of rows that repeat both, that of the smallest other columns stays, by their
    hash.  Rows without an id all stay.
    """
    found = _classes(df, id_col, text_col, threshold).filter(F.col(id_col).isNotNull() & F.col("kept"))
    kept, digest, place = (unused_name(df, name) for name in ("kept_id", "kept_digest", "kept_place"))
    documents = found.groupBy(F.col(id_col).alias(kept), F.col("digest").alias(digest)).count()
    documents = runtime.checkpointed(documents)
    named = df.withColumn(kept, F.col(id_col).cast("long")).withColumn(digest, digest_of(text_col))
    rows = named.join(documents.select(kept, digest), [kept, digest], "left_semi")
    if documents.filter("count > 1").limit(1).count():
        repeated = documents.filter("count > 1").select(kept, digest)
        once = rows.join(repeated, [kept, digest], "left_anti")
        order = F.struct(F.xxhash64(*(F.col(f"`{c}`") for c in df.columns)).alias(place), *(F.col(f"`{c}`") for c in df.columns))
        several = rows.join(repeated, [kept, digest], "left_semi")
        several = several.groupBy(kept, digest).agg(F.min_by(order, order[place]).alias("row"))
        rows = once.select(df.columns).unionByName(several.select(*(F.col("row").getField(c).alias(c) for c in df.columns)))
    return rows.select(df.columns).unionByName(df.filter(F.col(id_col).isNull()))
