"""A quality classifier on random-indexing word vectors.

Words hash into ``BUCKETS`` buckets.  Each bucket has a fixed random index
vector, ``NONZERO`` signs in ``DIM`` places, and gathers a context vector: the sum
of the index vectors of the words up to ``WINDOW`` places beside its own, over
all documents.  The sums are whole numbers, so they come out the same on every
run.  A document is the pooled context vectors of its words, rare words
weighing more, with a few ratios; a network of two layers in numpy scores it,
and a temperature fitted on rows kept aside calibrates its probabilities.

The context vectors cover every document; the network is fitted on at most
``max_train`` labelled documents, those of smallest hash.  The table of vectors
has a fixed size, so it can be sent to every task.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog_engine.llm.common import arrow_schema, slices

BUCKETS = 1 << 14
DIM = 32
NONZERO = 4
WINDOW = 2
MAX_TRAIN = 20_000
#: Pooling weight of a bucket: RARE / (RARE + its share of all words).
RARE = 1e-3
HIDDEN = 32
EPOCHS = 60
SEED = 7
KNOWN_WORDS = 400_000
# Words handled at once.
CHUNK = 1 << 18

TOKEN = re.compile(r"\w+|[^\w\s]+")


class Words:
    """Words of texts as bucket numbers."""

    def __init__(self):
        self.known: dict[str, int] = {}

    def buckets(self, text: str) -> np.ndarray:
        words = TOKEN.findall(text)
        known = self.known
        found = list(map(known.get, words))
        if None in found:
            if len(known) > KNOWN_WORDS:
                known.clear()
            for i, bucket in enumerate(found):
                if bucket is None:
                    word = words[i]
                    found[i] = bucket = zlib.crc32(word.encode()) % BUCKETS
                    if len(word) <= 64:
                        known[word] = bucket
        return np.array(found, np.int32)


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of every bucket's index vector."""
    rng = np.random.default_rng(SEED)
    places = np.argsort(rng.random((BUCKETS, DIM)), axis=1)[:, :NONZERO].astype(np.int64)
    signs = rng.choice([-1.0, 1.0], (BUCKETS, NONZERO))
    return places, signs


def gather(lists: list[np.ndarray], table: np.ndarray, counts: np.ndarray, places, signs) -> None:
    """Adds the contexts of some documents to ``table`` (flat, BUCKETS x DIM) and ``counts``."""
    words = np.concatenate([*lists, np.empty(0, np.int32)]).astype(np.int64)
    document = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    counts += np.bincount(words, minlength=BUCKETS)
    for offset in range(1, WINDOW + 1):
        same = document[offset:] == document[:-offset]
        left, right = words[:-offset][same], words[offset:][same]
        for word, beside in ((left, right), (right, left)):
            for k in range(NONZERO):
                table += np.bincount(
                    word * DIM + places[beside, k], weights=signs[beside, k], minlength=BUCKETS * DIM
                )


def context_vectors(df: DataFrame, text_col: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Context sums (BUCKETS x DIM) and word counts of all texts: a table of fixed size."""
    fields = [f"v{i}" for i in range(DIM)]
    schema = "bucket int, n bigint, " + ", ".join(f"{f} bigint" for f in fields)
    out = arrow_schema(schema)

    def run(batches):
        places, signs = index_vectors()
        table, counts, words = np.zeros(BUCKETS * DIM), np.zeros(BUCKETS, np.int64), Words()
        held, size = [], 0
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for part in slices(texts):
                for text in texts[part]:
                    found = words.buckets(text)
                    held.append(found)
                    size += len(found)
                    if size >= CHUNK:
                        gather(held, table, counts, places, signs)
                        held, size = [], 0
        if held:
            gather(held, table, counts, places, signs)
        seen = np.flatnonzero(counts)
        vectors = table.reshape(BUCKETS, DIM)[seen].astype(np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(seen.astype(np.int32)), pa.array(counts[seen]), *(pa.array(vectors[:, i]) for i in range(DIM))],
            schema=out,
        )

    parts = df.select(F.coalesce(F.col(text_col), F.lit("")).alias("t")).mapInArrow(run, schema)
    sums = parts.groupBy("bucket").agg(*(F.sum(c).alias(c) for c in ("n", *fields))).toArrow()
    bucket = sums["bucket"].to_numpy()
    vectors, counts = np.zeros((BUCKETS, DIM)), np.zeros(BUCKETS)
    for i, f in enumerate(fields):
        vectors[bucket, i] = sums[f].to_numpy()
    counts[bucket] = sums["n"].to_numpy()
    return vectors, counts


def pooling_table(vectors: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Context vectors of length 1, each followed by its pooling weight."""
    length = np.linalg.norm(vectors, axis=1, keepdims=True)
    unit = np.divide(vectors, length, out=np.zeros_like(vectors), where=length > 0)
    share = counts / max(1.0, counts.sum())
    weight = RARE / (RARE + share)
    return np.concatenate([unit, unit * weight[:, None], weight[:, None]], axis=1).astype(np.float32)


RATIOS = 7


def features(text: str, words: Words, table: np.ndarray) -> np.ndarray:
    """Pooled vectors of a text, plain and weighted, and ratios of its words and signs."""
    found = words.buckets(text)
    n = len(found)
    out = np.zeros(2 * DIM + RATIOS)
    if not n:
        return out
    total = np.zeros(2 * DIM + 1)
    for start in range(0, n, CHUNK):
        total += table[found[start : start + CHUNK]].sum(axis=0, dtype=np.float64)
    out[:DIM] = total[:DIM] / n
    out[DIM : 2 * DIM] = total[DIM : 2 * DIM] / max(total[-1], 1e-9)
    chars = max(1, len(text))
    letters = sum(map(len, re.findall(r"[^\W\d_]+", text)))
    upper = sum(map(len, re.findall(r"[A-ZÀ-ÖØ-Þ]+", text)))
    out[2 * DIM :] = (
        np.log1p(n) / 10,
        len(np.unique(found)) / n,
        float(np.mean(found[1:] == found[:-1])) if n > 1 else 0.0,
        letters / chars,
        upper / max(1, letters),
        len(re.findall(r"[^\w\s]", text)) / chars,
        len(re.findall(r"\d", text)) / chars,
    )
    return out


class Network:
    """Two layers, fitted by Adam on the cross entropy; ``temperature`` divides the last sum."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.base = (y.sum() + 1) / (len(y) + 2)
        self.mean, self.scale = (x.mean(axis=0), x.std(axis=0) + 1e-6) if len(x) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
        self.temperature, self.weights = 1.0, None
        if len(y) < 20 or y.min() == y.max():
            return  # nothing to tell apart: the share of good labels is the score
        rng = np.random.default_rng(SEED)
        order = rng.permutation(len(y))
        aside, fit = order[: max(4, len(y) // 5)], order[max(4, len(y) // 5) :]
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        w = [rng.normal(0, 1 / np.sqrt(z.shape[1]), (z.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
        m, v, step = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w], 0
        best, kept = np.inf, None
        for _ in range(EPOCHS):
            shuffled = rng.permutation(fit)
            for start in range(0, len(shuffled), 128):
                rows = shuffled[start : start + 128]
                h = np.maximum(z[rows] @ w[0] + w[1], 0)
                error = (1 / (1 + np.exp(-(h @ w[2] + w[3]))) - y[rows]) / len(rows)
                back = np.outer(error, w[2]) * (h > 0)
                grads = [z[rows].T @ back + 1e-4 * w[0], back.sum(0), h.T @ error + 1e-4 * w[2], error.sum(keepdims=True)]
                step += 1
                for a, g, first, second in zip(w, grads, m, v):
                    first += 0.1 * (g - first)
                    second += 0.001 * (g * g - second)
                    a -= 3e-3 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
            self.weights = w
            loss = self._loss(x[aside], y[aside])
            if loss < best:
                best, kept = loss, [a.copy() for a in w]
        self.weights = kept
        grid = np.exp(np.linspace(np.log(0.25), np.log(8), 60))
        logits = self.logits(x[aside])
        losses = [self._entropy(logits / t, y[aside]) for t in grid]
        self.temperature = float(grid[int(np.argmin(losses))])

    @staticmethod
    def _entropy(logits, y):
        return float(np.mean(np.logaddexp(0, logits) - y * logits))

    def _loss(self, x, y):
        return self._entropy(self.logits(x), y)

    def logits(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.maximum(z @ self.weights[0] + self.weights[1], 0) @ self.weights[2] + self.weights[3]

    def probability(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), self.base)
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -60, 60)))


def training_ids(labels: DataFrame, id_col: str, label_col: str, max_train: int, holdout: bool) -> DataFrame:
    """At most ``max_train`` labelled ids with their label: those of smallest hash.

    With ``holdout``, ids whose crc32 is divisible by 5 are left out.  Labels other than 0 and 1 and
    ids without one label are left out too.
    """
    rows = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1))
    if holdout:
        rows = rows.filter(held_out(id_col) == F.lit(False))
    one = rows.groupBy(F.col(id_col).alias("l_id")).agg(
        F.min(label_col).alias("label"), F.max(label_col).alias("most")
    )
    return (
        one.filter(F.col("label") == F.col("most"))
        .select("l_id", F.col("label").cast("double").alias("label"))
        .orderBy(F.xxhash64(F.col("l_id").cast("string")), "l_id")
        .limit(max_train)
    )


def held_out(id_col: str):
    """Whether a document is kept out of the fit: crc32(id as text) mod 5 is 0; null: false."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    max_train: int = MAX_TRAIN,
    holdout: bool = True,
) -> tuple[np.ndarray, Network]:
    """The table of word vectors, from all documents, and the network, from at most
    ``max_train`` labelled ones."""
    table = pooling_table(*context_vectors(docs, text_col))
    width = 2 * DIM + RATIOS
    schema = "h bigint, label double, x binary"
    out = arrow_schema(schema)

    def run(batches):
        words = Words()
        for batch in batches:
            texts = batch.column(0).to_pylist()
            rows = [features(t, words, table).tobytes() for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(1), pa.array(rows, pa.binary())], schema=out)

    chosen = training_ids(labels, id_col, label_col, max_train, holdout)
    # Bounded by max_train rows of two numbers.
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("d_id"), text.alias("t")).join(
        F.broadcast(chosen), F.col("d_id") == F.col("l_id")
    )
    # An id that repeats gives one row: rows of a fit stay bounded by max_train.
    one = rows.groupBy("d_id", "label").agg(F.min("t").alias("t"))
    sample = one.select("t", "label", F.xxhash64(F.col("d_id").cast("string")).alias("h"))
    got = sample.mapInArrow(run, schema).toArrow()
    order = np.argsort(got["h"].to_numpy(), kind="stable")
    x = np.frombuffer(b"".join(got["x"].to_pylist()), np.float64).reshape(-1, width)[order]
    y = got["label"].to_numpy()[order]
    return table, Network(x, y)


def score(
    docs: DataFrame, table: np.ndarray, network: Network, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: the id and ``score``, the probability of a good label.

    Whole texts; a null text is scored as an empty one; null and repeated ids
    are kept; an empty table gives an empty one; no other column is read.
    """
    schema = f"id {docs.schema[id_col].dataType.simpleString()}, score double"
    out = arrow_schema(schema)
    run = scorer(table, network, out)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def scorer(table, network, out):
    def run(batches):
        words = Words()
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for part in slices(texts):
                x = np.array([features(t, words, table) for t in texts[part]])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(part.start, len(x)), pa.array(network.probability(x))], schema=out
                )

    return run


def keep_good(
    docs: DataFrame, table: np.ndarray, network: Network, threshold: float = 0.3, text_col: str = "text"
) -> DataFrame:
    """The rows of ``docs`` whose score is at least ``threshold``; same columns."""
    at, schema = docs.columns.index(text_col), docs.schema

    def run(batches):
        words = Words()
        for batch in batches:
            texts = [t or "" for t in batch.column(at).to_pylist()]
            for part in slices(texts):
                x = np.array([features(t, words, table) for t in texts[part]])
                some = batch.slice(part.start, len(x))
                kept = pa.array(network.probability(x) >= threshold)
                yield pa.RecordBatch.from_arrays([c.filter(kept) for c in some.columns], schema=some.schema)

    return docs.mapInArrow(run, schema)
