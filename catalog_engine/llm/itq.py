"""Near-duplicate vectors by iterative quantisation and multi-index Hamming tables.

Rotations are learned that bring the vectors of a sample close to the corners of a
cube; the signs after a rotation are a vector's code.  The bits of several rotations are cut into
substrings, one Hamming table each: vectors that agree in a substring meet in
a bucket, and the original vectors decide, in double precision.  The data are
not centred, so that codes follow angles, which the threshold is about.

With b bits a table and the chance p = angle / pi that a bit differs, a pair meets
in a table with chance (1 - p)**b; the number of tables is what brings a pair
at the threshold to ``FOUND``.  The bits grow with the logarithm of the number of
vectors, so that a bucket of unrelated vectors holds some dozens.  Closer pairs are missed far less often.

Pairs never leave a block: it counts each vector's links and reports who is connected.
A pair that meets in several tables counts in the first.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog_engine import runtime
from catalog_engine.llm.blocks import gathered, groups, paired
from catalog_engine.llm.common import arrow_schema
from catalog_engine.llm.components import components
from catalog_engine.llm.vectors_in import by_size, float_type, sample, scaled, usable

THRESHOLD = 0.9
#: Chance that a pair of exactly the threshold meets in some table.
FOUND = 0.99
ITERATIONS = 25
BLOCK = 1024
SEED = 11


def rotation(x: np.ndarray, seed: int, iterations: int = ITERATIONS) -> np.ndarray:
    """An orthogonal matrix that brings the rows of ``x``, of length 1, near the corners of a cube."""
    d = x.shape[1]
    r, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(d, d)))
    for _ in range(iterations if len(x) > d else 0):
        turned = x @ r
        u, _, vt = np.linalg.svd(x.T @ np.where(turned >= 0, 1.0, -1.0))
        r = u @ vt
    return r


def plan(n: int, threshold: float = THRESHOLD, found: float = FOUND) -> tuple[int, int]:
    """Bits of a table, and tables, for ``n`` vectors."""
    bits = min(28, max(6, round(math.log2(max(2, n))) - 6))
    meet = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - found) / math.log(1 - meet))


class Codes:
    """Substring codes of vectors of any size; rotations of sizes the sample lacks are not fitted."""

    def __init__(self, samples: dict[int, np.ndarray], bits: int, tables: int):
        self.bits, self.tables = bits, tables
        self.rotations = {size: self._fit(size, x) for size, x in samples.items()}

    def _fit(self, size: int, x: np.ndarray) -> np.ndarray:
        if len(x):
            x = scaled(x)
            x = x / np.linalg.norm(x, axis=1, keepdims=True)
        needed = math.ceil(self.bits * self.tables / size)
        return np.concatenate([rotation(x, SEED + i) for i in range(needed)], axis=1)

    def of(self, size: int, x: np.ndarray) -> np.ndarray:
        """An array rows x tables of substring codes."""
        if size not in self.rotations:
            self.rotations[size] = self._fit(size, np.empty((0, size)))
        turned = scaled(x) @ self.rotations[size]
        on = turned[:, : self.bits * self.tables].reshape(len(x), self.tables, self.bits) >= 0
        return on @ (1 << np.arange(self.bits, dtype=np.int64))


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest row that links (a, b) connect each row to."""
    label = np.arange(n)
    while True:
        least = label.copy()
        np.minimum.at(least, a, label[b])
        np.minimum.at(least, b, label[a])
        least = least[least]
        if (least == label).all():
            return label
        label = least


def _compare(group: pa.Table, threshold: float, dtype) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids with links in a block, their number of links, and the smallest id the block connects them to."""
    _, table, _, p, q = (group.column(i)[0].as_py() for i in range(5))
    side, ids, copies = (group.column(i).to_numpy() for i in (5, 6, 7))
    order = np.argsort(ids, kind="stable")
    side, ids, copies = side[order], ids[order], copies[order]
    codes = group.column(8).combine_chunks().flatten().to_numpy().reshape(len(ids), -1)[order]
    x = np.frombuffer(b"".join(group.column(9).to_pylist()), dtype).reshape(len(ids), -1)[order].astype(np.float64)
    x = scaled(x)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    found_a, found_b = [], []
    left = np.flatnonzero(side == p)
    right = left if p == q else np.flatnonzero(side == q)
    for start in range(0, len(left), 256):
        rows = left[start : start + 256]
        a, b = np.nonzero(x[rows] @ x[right].T >= threshold)
        a, b = rows[a], right[b]
        if p == q:
            a, b = a[a < b], b[a < b]
        if table and len(a):
            new = ~(codes[a, :table] == codes[b, :table]).any(axis=1)
            a, b = a[new], b[new]
        found_a.append(a)
        found_b.append(b)
    a, b = np.concatenate(found_a), np.concatenate(found_b)
    if not len(a):
        return ids[:0], ids[:0], ids[:0]
    links = np.bincount(a, copies[b], len(ids)) + np.bincount(b, copies[a], len(ids))
    root = ids[roots(len(ids), a, b)]
    linked = np.flatnonzero(links)
    return ids[linked], links[linked].astype(np.int64), root[linked]


def near_vectors(
    df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", threshold: float = THRESHOLD
) -> DataFrame:
    """One row per row of ``df``: the id, ``n_links``, ``component_id`` and ``kept``.

    Vectors are linked when their cosine is at least ``threshold``; only vectors
    of the same size are compared.  ``n_links`` counts the other rows linked directly,
    copies of the vector among them; a component is named by its smallest id.
    Vectors that are null, zero or hold null or non-finite components
    link with nothing, nor do rows without an id (component null, not kept).  Repeated rows are
    copies; an id that repeats with different vectors counts the links of all of
    them.  Empty tables give empty ones; other columns are not read.
    """
    kind = float_type(df, vector)
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector).alias("v"))
    ready = rows.filter(F.col("id").isNotNull() & usable("v"))
    distinct = runtime.checkpointed(
        ready.groupBy("v").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    )
    bits, tables = plan(distinct.count(), threshold)
    codes = Codes(sample(distinct, "rep", "v"), bits, tables)
    schema = "size int, rep bigint, copies bigint, codes array<bigint>, packed binary"
    out = arrow_schema(schema)
    dtype = np.dtype("<f4" if kind == "float" else "<f8")

    def encode(batches):
        for batch in batches:
            for size, (at, x) in by_size(batch.column(0)).items():
                found = codes.of(size, x)
                lists = pa.ListArray.from_arrays(
                    pa.array(np.arange(len(at) + 1) * tables, pa.int32()), pa.array(found.ravel())
                )
                packed = [row.tobytes() for row in x.astype(dtype)]
                ids = [batch.column(i).take(pa.array(at)) for i in (1, 2)]
                size_column = pa.array(np.full(len(at), size, np.int32))
                yield pa.RecordBatch.from_arrays(
                    [size_column, *ids, lists.cast(out.field(3).type), pa.array(packed, pa.binary())], schema=out
                )

    coded = distinct.select("v", "rep", "copies").mapInArrow(encode, schema)
    coded = runtime.checkpointed(coded)
    keys = ["size", "table", "code"]
    placed = coded.select("size", "rep", "copies", "codes", "packed", F.posexplode("codes").alias("table", "code"))
    # Buckets of one vector have nothing to compare.
    counts = (
        coded.select("size", F.posexplode("codes").alias("table", "code")).groupBy(*keys).count().filter("count > 1")
    )
    counts = runtime.checkpointed(counts)
    placed = placed.join(runtime.broadcast_if_small(counts.select(*keys)), keys, "left_semi")
    dealt = paired(placed, keys, "rep", BLOCK, counts)
    dealt = gathered(dealt.select(*keys, "p", "q", "s", "rep", "copies", "codes", "packed"), [*keys, "p", "q"])
    schema = "id bigint, links bigint, root bigint"
    found_schema = arrow_schema(schema)

    def compare(batches):
        for group in groups(batches, 5):
            found = _compare(group, threshold, dtype)
            if len(found[0]):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], schema=found_schema)

    found = runtime.checkpointed(dealt.mapInArrow(compare, schema))
    linked = found.groupBy(F.col("id").alias("l_id")).agg(F.sum("links").alias("links"))
    joined = components(found.filter("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b")))
    by_rep = (
        distinct.join(linked, F.col("rep") == F.col("l_id"), "left")
        .join(joined, F.col("rep") == F.col("id"), "left")
        .groupBy(F.col("v").alias("key"))
        .agg(
            F.max((F.coalesce("links", F.lit(0)) + F.col("copies") - 1)).alias("n_links"),
            F.min(F.coalesce("component", "rep")).alias("component"),
        )
    )
    known = ready.join(by_rep, ready["v"] == by_rep["key"]).select(
        F.col("id").alias(id_col), "n_links", F.col("component").alias("component_id")
    )
    alone = rows.filter(~(F.col("id").isNotNull() & usable("v"))).select(
        F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id")
    )
    return known.unionByName(alone).withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(False)))
