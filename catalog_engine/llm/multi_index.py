"""Nearest neighbours by an inverted multi-index.

Vectors are cut into two halves and each half is quantised by a codebook of its own; a
cell is a pair of centroids.  A query visits the cells in the order of its
summed squared distances to both centroids, taken from a heap that grows from the nearest pair, until the
cells hold enough vectors, and those are ranked by their distance on the original
vectors, in double precision.

Codebooks are fitted on a sample of at most ``SAMPLE`` vectors, and so is how many vectors are
enough: the share of the sample that a query must visit for ``RECALL`` of its true
neighbours there.  A share that suits a sample suits the whole, where
neighbours are nearer.  All vectors are indexed.  Cells of many vectors are split
over tasks; queries stream past them, and a task merges what its cells answer.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from catalog_engine import runtime
from catalog_engine.llm.common import arrow_schema
from catalog_engine.llm.vectors_in import by_size, float_type, sample, usable

SAMPLE = 8192
RECALL = 0.97
#: Vectors a query looks at, at least.
LEAST = 256
#: Mean vectors of a cell, up to MOST_CENTROIDS a half.
CELL = 100
MOST_CENTROIDS = 256
#: Vectors of a cell that one task holds.
BLOCK = 4096
#: Answers a task holds before it merges them by query.
HELD_ANSWERS = 1 << 18
SEED = 5


def codebook(x: np.ndarray, k: int, rounds: int = 15) -> np.ndarray:
    """k-means centroids; those that lose all rows stay where they are."""
    centroids = x[np.random.default_rng(SEED).permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        nearest = assign(x, centroids)
        sizes = np.bincount(nearest, minlength=len(centroids))
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, x)
        centroids[sizes > 0] = sums[sizes > 0] / sizes[sizes > 0, None]
    return centroids


def distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] - 2 * x @ centroids.T + (centroids * centroids).sum(1)


def assign(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.concatenate(
        [distances(x[i : i + 4096], centroids).argmin(1) for i in range(0, len(x), 4096)] or [np.empty(0, int)]
    )


#: Components that codebooks tell apart, and distances whose squares are surely in range.
FAR, NEAR = 1e100, 1e-140


def bounded(x: np.ndarray) -> np.ndarray:
    """Components as codebooks see them: their squares are finite."""
    return np.clip(x, -FAR, FAR)


def gaps(block: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Euclidean distances from ``query``, also where the squares of the differences are out of range."""
    with np.errstate(over="ignore", invalid="ignore"):
        apart = block - query
        found = np.sqrt((apart**2).sum(axis=1))
        odd = np.flatnonzero(~(found < np.inf) | (found < NEAR))
        if len(odd):
            exponent = np.frexp(np.abs(apart[odd]).max(axis=1, initial=0.0))[1]
            small = np.ldexp(apart[odd], -exponent[:, None])
            found[odd] = np.ldexp(np.sqrt((small**2).sum(axis=1)), exponent)
    return found


class Index:
    """Codebooks of vectors of one size, and the share of them that a query visits."""

    def __init__(self, x: np.ndarray, n: int, top: int):
        x = bounded(x)
        self.half = x.shape[1] // 2
        k = min(len(x), max(1, min(MOST_CENTROIDS, round(math.sqrt(n / CELL)))))
        self.books = [codebook(x[:, : self.half], k), codebook(x[:, self.half :], k)]
        self.k = k
        self.share = self._calibrated(x, top)

    def cells(self, x: np.ndarray) -> np.ndarray:
        x = bounded(x)
        return assign(x[:, : self.half], self.books[0]) * self.k + assign(x[:, self.half :], self.books[1])

    def order(self, query: np.ndarray):
        """Cells by summed distance.  A pair comes after both pairs that are one step nearer in
        one half, so the heap never holds more than one pair a row."""
        query = bounded(query)
        first = distances(query[None, : self.half], self.books[0])[0]
        second = distances(query[None, self.half :], self.books[1])[0]
        a, b = np.argsort(first, kind="stable").tolist(), np.argsort(second, kind="stable").tolist()
        first, second = first[a].tolist(), second[b].tolist()
        reached = [0] * self.k  # pairs of each row that have left the heap
        heap, k = [(first[0] + second[0], 0, 0)], self.k
        while heap:
            _, i, j = heapq.heappop(heap)
            yield a[i] * k + b[j]
            reached[i] = j + 1
            if i + 1 < k and reached[i + 1] == j:
                heapq.heappush(heap, (first[i + 1] + second[j], i + 1, j))
            if j + 1 < k and (i == 0 or reached[i - 1] > j + 1):
                heapq.heappush(heap, (first[i] + second[j + 1], i, j + 1))

    def visited(self, query: np.ndarray, sizes: np.ndarray, enough: float) -> list[int]:
        """The cells that hold vectors, nearest first, until they hold ``enough``."""
        found, held = [], 0
        for cell in self.order(query):
            if sizes[cell]:
                found.append(cell)
                held += int(sizes[cell])
                if held >= enough:
                    break
        return found

    def _calibrated(self, x: np.ndarray, top: int) -> float:
        """The share of the sample to visit, so that its queries find RECALL of their neighbours in it."""
        n = len(x)
        if n <= top + 1:
            return 1.0
        cells, sizes = self.cells(x), None
        sizes = np.bincount(cells, minlength=self.k**2)
        needed = []
        for row in np.random.default_rng(SEED).permutation(n)[:200]:
            gap = ((x - x[row]) ** 2).sum(1)
            gap[row] = np.inf
            nearest = np.argpartition(gap, top)[:top]
            place = np.zeros(self.k**2)
            held = 0
            for cell in self.visited(x[row], sizes, n + 1):
                held += sizes[cell]
                place[cell] = held
            needed.extend(place[cells[nearest]] / n)
        return float(np.quantile(needed, RECALL))


def nearest(
    df: DataFrame,
    queries: DataFrame,
    id_col: str = "vec_id",
    vector: str = "embedding",
    top: int = 10,
) -> DataFrame:
    """The ``top`` nearest rows of ``df`` found for each row of ``queries`` (same columns):
    ``query_id, rank, <id>, score``, the Euclidean distance; ties go to the smaller id.

    A query's own id is no candidate.  Only vectors of the same size are
    compared; vectors that are null, zero or hold null or non-finite
    components, and rows without an id, take no part on either side.  Repeated rows
    count once; of a candidate id with several vectors the nearest counts, of a query id with
    several the smallest vector asks.  Empty tables give an empty result; other columns are not read.
    """
    kind = float_type(df, vector)
    dtype = np.dtype("<f4" if kind == "float" else "<f8")

    def ready(rows):
        rows = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector).alias("v"))
        return rows.filter(F.col("id").isNotNull() & usable("v"))

    entries = runtime.checkpointed(ready(df).distinct())
    asked = ready(queries).groupBy("id").agg(F.min("v").alias("v"))
    by = {r["size"]: r["count"] for r in entries.groupBy(F.size("v").alias("size")).count().collect()}
    index = {size: Index(x, by[size], top) for size, x in sample(entries, "id", "v", SAMPLE).items()}
    schema = "size int, cell int, id bigint, packed binary"
    out = arrow_schema(schema)

    def rows_of(size, cell, ids, x, schema):
        packed = pa.array([row.tobytes() for row in x.astype(dtype)], pa.binary())
        sizes = pa.array(np.full(len(ids), size, np.int32))
        return pa.RecordBatch.from_arrays([sizes, pa.array(cell, schema.field(1).type), ids, packed], schema=schema)

    def place(batches):
        for batch in batches:
            for size, (at, x) in by_size(batch.column(1)).items():
                cells = index[size].cells(x) if size in index else np.zeros(len(at), int)
                yield rows_of(size, cells.astype(np.int32), batch.column(0).take(pa.array(at)), x, out)

    placed = runtime.checkpointed(entries.select("id", "v").mapInArrow(place, schema))
    # At most MOST_CENTROIDS squared rows for each vector size.
    counts = placed.groupBy("size", "cell").count()
    sizes: dict[int, np.ndarray] = {}
    for r in counts.collect():
        cells = sizes.setdefault(r["size"], np.zeros(index[r["size"]].k ** 2 if r["size"] in index else 1, np.int64))
        cells[r["cell"]] = r["count"]
    visit_schema = "size int, cell array<int>, id bigint, packed binary"
    visit_out = arrow_schema(visit_schema)

    def visit(batches):
        for batch in batches:
            for size, (at, x) in by_size(batch.column(1)).items():
                if size not in sizes:
                    continue
                total = sizes[size].sum()
                if size in index:
                    enough = max(index[size].share * total, min(total, LEAST))
                    cells = [index[size].visited(query, sizes[size], enough) for query in x]
                else:
                    cells = [[0] for _ in at]
                yield rows_of(size, cells, batch.column(0).take(pa.array(at)), x, visit_out)

    visits = asked.select("id", "v").mapInArrow(visit, visit_schema)
    visits = visits.withColumn("cell", F.explode("cell"))
    large = counts.filter(F.col("count") > BLOCK)
    large = large.select("size", "cell", F.ceil(F.col("count") / BLOCK).cast("int").alias("parts"))
    large = F.broadcast(large)  # a part of counts, which is bounded
    parts = F.coalesce(F.col("parts"), F.lit(1))
    part = F.pmod(F.xxhash64("id"), parts).cast("int")
    names = ["size", "cell", "part", "kind", "id", "packed"]
    held = placed.join(large, ["size", "cell"], "left").select(
        "size", "cell", part.alias("part"), F.lit(0).alias("kind"), "id", "packed"
    )
    every = F.explode(F.sequence(F.lit(0), parts - 1))
    asking = visits.join(large, ["size", "cell"], "left").select(
        "size", "cell", every.alias("part"), F.lit(1).alias("kind"), "id", "packed"
    )
    met = held.unionByName(asking).select(*names).repartition("size", "cell", "part").sortWithinPartitions(*names[:4])
    found_schema = "query_id bigint, id bigint, score double"
    found_out = arrow_schema(found_schema)

    def rank(batches):
        at, ids, block = None, [], []
        answers, held = [], 0
        for batch in batches:
            keys = np.stack([batch.column(i).to_numpy() for i in range(4)], axis=1)
            row_ids, packed = batch.column(4).to_numpy(), batch.column(5)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            for start, end in zip([0, *cuts], [*cuts, len(keys)]):
                if not end:
                    continue
                key, x = tuple(keys[start, :3]), np.frombuffer(b"".join(packed[start:end].to_pylist()), dtype)
                x = x.reshape(end - start, -1).astype(np.float64)
                if key != at:
                    at, ids, block = key, np.empty(0, np.int64), np.empty((0, x.shape[1]))
                if not keys[start, 3]:
                    ids, block = np.concatenate([ids, row_ids[start:end]]), np.concatenate([block, x])
                    continue
                for query, q in zip(row_ids[start:end], x):
                    found, far = best(gaps(block, q), ids, query, top)
                    answers.append((np.full(len(found), query), found, far))
                    held += len(found)
            if held >= HELD_ANSWERS:
                merged = merge(answers, top)
                held = len(merged[0])
                answers = [merged]
                if held >= HELD_ANSWERS // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in merged], schema=found_out)
                    answers, held = [], 0
        if answers:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in merge(answers, top)], schema=found_out)

    found = met.mapInArrow(rank, found_schema)
    first = Window.partitionBy("query_id").orderBy("score", "id")
    once = found.groupBy("query_id", "id").agg(F.min("score").alias("score")) if _ids_repeat(entries) else found
    return (
        once.withColumn("rank", F.row_number().over(first))
        .filter(F.col("rank") <= top)
        .select("query_id", "rank", F.col("id").alias(id_col), "score")
    )


def merge(answers: list[tuple[np.ndarray, np.ndarray, np.ndarray]], top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Answers of several blocks (query, id, distance): the ``top`` of each query, each id once."""
    query, ids, gap = (np.concatenate(c) for c in zip(*answers))
    order = np.lexsort((gap, ids, query))
    query, ids, gap = query[order], ids[order], gap[order]
    first = np.ones(len(query), bool)
    first[1:] = (query[1:] != query[:-1]) | (ids[1:] != ids[:-1])
    query, ids, gap = query[first], ids[first], gap[first]
    order = np.lexsort((ids, gap, query))
    query, ids, gap = query[order], ids[order], gap[order]
    place = np.arange(len(query)) - np.searchsorted(query, query)
    return query[place < top], ids[place < top], gap[place < top]


def _ids_repeat(entries: DataFrame) -> bool:
    return entries.groupBy("id").count().filter("count > 1").limit(1).count() > 0


def best(gap: np.ndarray, ids: np.ndarray, own: int, top: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and distances of the ``top`` nearest, each id once, the query's own left out."""
    if len(gap) > 4 * top:
        near = np.flatnonzero(gap <= np.partition(gap, 2 * top)[2 * top])
    else:
        near = np.arange(len(gap))
    order = near[np.lexsort((ids[near], gap[near]))]
    order = order[ids[order] != own]
    _, firsts = np.unique(ids[order], return_index=True)
    if len(firsts) < top and len(near) < len(gap):
        order = np.lexsort((ids, gap))
        order = order[ids[order] != own]
        _, firsts = np.unique(ids[order], return_index=True)
    order = order[np.sort(firsts)[:top]]
    return ids[order], gap[order]
