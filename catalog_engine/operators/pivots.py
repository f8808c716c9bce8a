"""Exact cosine top-N that leaves out groups of items by the triangle inequality of angles.

Items are grouped by their nearest pivot, and within that by rings of their angle
to it.  The angle of a target to any item of a ring is at least the difference
between the target's angle to the pivot and the ring's.  Each target first meets
the rings nearest to it, which gives it ``n`` neighbours and so a floor; then
only the rings that can hold something above the floor.  On clustered vectors that
is a small share of all items; on vectors without structure nearly all.

Rings are few, at most ``pivots`` x ``RINGS`` of each vector size, so what is known
of them goes to every task.  Items and the targets that ask for them meet by
ring; large rings are split, and so are rings that many targets ask for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from catalog_engine import runtime
from catalog_engine.operators import similar
from catalog_engine.operators.keys import unlisted

#: Rings of a pivot, of equal width.
RINGS = 64
#: Items of a part of a ring, and targets that meet it together.
PART, ASKING = 1 << 16, 1 << 12
#: Angles are trusted to this much; similarities to half of their last decimal.
SLACK = 1e-6


def pivots_of(items: DataFrame, key: str, pivots: int) -> dict[int, np.ndarray]:
    """Unit rows of at most ``pivots`` items, those of smallest hash, by vector size."""
    chosen = items.orderBy(F.xxhash64(F.col(key).cast("string"), "_vec")).limit(pivots).select("_vec").toArrow()
    vecs = chosen.column("_vec")
    found = {}
    for size in set(vecs.combine_chunks().value_lengths().to_pylist()) if chosen.num_rows else ():
        unit = similar._unit_rows(vecs, size)
        unit = unit[~np.isnan(unit).any(axis=1)]
        if len(unit):
            found[size] = unit
    return found


def angles(unit: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(unit @ pivots.T, -1.0, 1.0))


def grouped(items: DataFrame, key: str, pivots: dict[int, np.ndarray]) -> DataFrame:
    """``size, pivot, ring, angle``, the key and ``_vec`` of every item that has a direction.

    Items of a size that no pivot has are one ring of pivot -1.
    """
    shipped = items.sparkSession.sparkContext.broadcast(pivots)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vecs = pa.chunked_array([batch.column("_vec")])
            lengths = batch.column("_vec").value_lengths().to_numpy(zero_copy_only=False)
            for size in np.unique(lengths):
                unit = similar._unit_rows(vecs, int(size))
                rows = np.flatnonzero(~np.isnan(unit).any(axis=1))
                pivot, angle = np.full(len(rows), -1), np.zeros(len(rows))
                if int(size) in shipped.value and len(rows):
                    all_angles = angles(unit[rows], shipped.value[int(size)])
                    pivot = all_angles.argmin(axis=1)
                    angle = all_angles[np.arange(len(rows)), pivot]
                ring = np.minimum(angle * (RINGS / np.pi), RINGS - 1).astype(np.int32)
                chosen = batch.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(rows), size, np.int32)),
                        pa.array(pivot.astype(np.int32)),
                        pa.array(ring),
                        pa.array(angle),
                        chosen.column(key),
                        chosen.column("_vec"),
                    ],
                    ["size", "pivot", "ring", "angle", key, "_vec"],
                )

    kinds = dict(items.dtypes)
    return items.select(key, "_vec").mapInArrow(
        place, f"size int, pivot int, ring int, angle double, `{key}` {kinds[key]}, _vec {kinds['_vec']}"
    )


def rings_of(groups: DataFrame) -> pa.Table:
    """``size, pivot, ring, items, low, high``: a row per ring that holds items."""
    found = groups.groupBy("size", "pivot", "ring").agg(
        F.count(F.lit(1)).alias("items"), F.min("angle").alias("low"), F.max("angle").alias("high")
    )
    return found.orderBy("size", "pivot", "ring").toArrow()


def visits(targets: DataFrame, pivots: dict[int, np.ndarray], rings: pa.Table, n: int | None) -> DataFrame:
    """``target, _vec, size, pivot, ring`` for each ring that a target has to meet.

    With ``n`` these are the nearest rings that hold more than ``n`` items
    together; else the others that may hold one at least as similar as ``floor``.
    """
    kinds = dict(targets.dtypes)
    shipped = targets.sparkSession.sparkContext.broadcast((pivots, rings))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, rings = shipped.value
        sizes = rings.column("size").to_numpy()
        pivot, low, high = (rings.column(c).to_numpy() for c in ("pivot", "low", "high"))
        held = rings.column("items").to_numpy()
        for batch in batches:
            vecs = pa.chunked_array([batch.column("_vec")])
            lengths = batch.column("_vec").value_lengths().to_numpy(zero_copy_only=False)
            for size in np.unique(lengths):
                at = np.flatnonzero(sizes == size)
                unit = similar._unit_rows(vecs, int(size))
                rows = np.flatnonzero(~np.isnan(unit).any(axis=1))
                if not len(at) or not len(rows):
                    continue
                # A ring without a pivot is always met.
                apart = np.zeros((len(rows), len(at)))
                known = pivot[at] >= 0
                if known.any():
                    here = angles(unit[rows], pivots[int(size)])[:, pivot[at][known]]
                    apart[:, known] = np.maximum(0.0, np.maximum(here - high[at][known], low[at][known] - here))
                order = np.argsort(apart, axis=1, kind="stable")
                reached = np.cumsum(held[at][order], axis=1)
                nearest = np.zeros(apart.shape, bool)
                enough = batch.column("first").to_numpy()[rows] if n is None else np.full(len(rows), n + 1)
                np.put_along_axis(nearest, order, reached - held[at][order] < enough[:, None], axis=1)
                if n is None:
                    floor = batch.column("floor").to_numpy(zero_copy_only=False)[rows]
                    possible = np.cos(np.maximum(0.0, apart - SLACK)) >= floor[:, None] - 10.0**-similar.DECIMALS
                    nearest = ~nearest & possible
                t, r = np.nonzero(nearest)
                asked = batch.take(pa.array(rows[t]))
                place = rings.take(pa.array(at[r])).combine_chunks()
                yield pa.RecordBatch.from_arrays(
                    [asked.column("target"), asked.column("_vec"), *(place.column(c).combine_chunks() for c in ("size", "pivot", "ring"))],
                    ["target", "_vec", "size", "pivot", "ring"],
                )

    return targets.mapInArrow(
        choose, f"target {kinds['target']}, _vec {kinds['_vec']}, size int, pivot int, ring int"
    )


RING = ["size", "pivot", "ring"]


def _meet(groups: DataFrame, rings: DataFrame, asked: DataFrame, key: str, n: int) -> DataFrame:
    """The ``n`` nearest items of the rings that each target asks for, a list per task; to be merged."""
    counts = asked.groupBy(*RING).agg(F.ceil(F.count(F.lit(1)) / ASKING).cast("int").alias("chunks"))
    # At most one small row a ring.
    split = rings.join(counts, RING).withColumn("parts", F.ceil(F.col("items") / PART).cast("int"))
    split = F.broadcast(split.select(*RING, "chunks", "parts"))
    number = F.concat_ws(":", *RING, "part", "chunk")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    items = (
        groups.join(split, RING)
        .withColumn("part", F.pmod(F.monotonically_increasing_id(), F.col("parts")))
        .withColumn("chunk", every("chunks"))
        .select(number.alias("group"), F.lit(True).alias("item"), F.lit(None).alias("target"), key, "_vec")
    )
    targets = (
        asked.join(split, RING)
        .withColumn("chunk", F.pmod(F.xxhash64("target"), F.col("chunks")))
        .withColumn("part", every("parts"))
        .select(number.alias("group"), F.lit(False).alias("item"), "target", F.lit(None).alias(key), "_vec")
    )
    kinds = dict(items.dtypes) | {"target": dict(targets.dtypes)["target"]}

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, asking, nearest = None, [], None
        for batch in batches:
            group = batch.column("group").dictionary_encode().indices.to_numpy()
            is_item = np.asarray(batch.column("item"))
            changes = np.flatnonzero((group[1:] != group[:-1]) | (is_item[1:] != is_item[:-1])) + 1
            cuts = [0, *changes.tolist(), batch.num_rows]
            for start, end in zip(cuts[:-1], cuts[1:]):
                if start == end:
                    continue
                name = batch.column("group")[start].as_py()
                if name != at:
                    if nearest is not None:
                        yield from nearest.result().to_batches()
                    at, asking, nearest = name, [], None
                rows = pa.Table.from_batches([batch.slice(start, end - start)])
                if not is_item[start]:
                    asking.append(rows.select(["target", "_vec"]))
                    continue
                nearest = nearest or similar._Nearest(pa.concat_tables(asking), key, n)
                nearest.add(rows.select([key, "_vec"]))
        if nearest is not None:
            yield from nearest.result().to_batches()

    both = targets.withColumn(key, F.col(key).cast(kinds[key])).unionByName(
        items.withColumn("target", F.col("target").cast(kinds["target"]))
    )
    dealt = both.repartition("group").sortWithinPartitions("group", "item")
    return dealt.mapInArrow(scan, f"target {kinds['target']}, `{key}` {kinds[key]}, similarity double")


def _best(scored: DataFrame, key: str, n: int) -> DataFrame:
    best = Window.partitionBy("target").orderBy(F.desc_nulls_last("similarity"), key)
    return scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= n)


def _sides(items: DataFrame, targets: DataFrame, key: str, vec: str, target_key: str) -> tuple[DataFrame, DataFrame]:
    items = items.select(F.col(key), F.col(vec).alias("_vec")).filter(F.col("_vec").isNotNull() & F.col(key).isNotNull())
    targets = targets.select(F.col(target_key).alias("target"), F.col(vec).alias("_vec")).filter(F.col("_vec").isNotNull())
    return items, runtime.checkpointed(targets.groupBy("target").agg(F.min("_vec").alias("_vec")))


def top_n_pivots(
    items: DataFrame,
    targets: DataFrame,
    key: str,
    vec: str,
    n: int,
    target_key: str | None = None,
    pivots: int = 256,
) -> DataFrame:
    """What :func:`similar.top_n_batch` gives, meeting only the rings of items that can matter.

    A target that has fewer than ``n`` items of its size and with a direction is
    answered by that function, so that the two agree in all cases.
    """
    items, targets = _sides(items, targets, key, vec, target_key or key)
    chosen = pivots_of(items, key, pivots)
    groups = runtime.checkpointed(grouped(items, key, chosen))
    rings = rings_of(groups)
    table = items.sparkSession.createDataFrame(rings) if rings.num_rows else None
    if table is None:
        return similar.top_n_batch(items, targets.withColumnRenamed("target", key), key, "_vec", n)
    asked = runtime.checkpointed(visits(targets, chosen, rings, n))
    near = runtime.checkpointed(_best(_meet(groups, table, asked, key, n), key, n).drop("rank"))
    floors = near.groupBy("target").agg(
        F.when(F.count(F.lit(1)) >= n, F.min("similarity")).otherwise(-2.0).alias("floor")
    )
    known = targets.join(floors, "target", "left").select(
        "target", "_vec", F.coalesce("floor", F.lit(-2.0)).alias("floor"), F.lit(n + 1).alias("first")
    )
    more = runtime.checkpointed(visits(known, chosen, rings, None))
    found = runtime.checkpointed(_best(near.unionByName(_meet(groups, table, more, key, n)), key, n))
    # Too few neighbours with a similarity: all items are looked at.
    short = unlisted(targets, found.filter(F.col("rank") == n).select("target"), "target")
    short = runtime.checkpointed(short)
    if short.isEmpty():
        return found
    rest = similar.top_n_batch(items, short.withColumnRenamed("target", key), key, "_vec", n)
    return unlisted(found, short.select("target"), "target").unionByName(rest)


def skipped_share(
    items: DataFrame, targets: DataFrame, key: str, vec: str, n: int, target_key: str | None = None, pivots: int = 256
) -> float:
    """The share of all pairs of a target and an item that ``top_n_pivots`` does not look at."""
    items, targets = _sides(items, targets, key, vec, target_key or key)
    chosen = pivots_of(items, key, pivots)
    groups = runtime.checkpointed(grouped(items, key, chosen))
    rings = rings_of(groups)
    table = F.broadcast(items.sparkSession.createDataFrame(rings))
    asked = runtime.checkpointed(visits(targets, chosen, rings, n))
    near = _best(_meet(groups, table, asked, key, n), key, n)
    floors = near.groupBy("target").agg(
        F.when(F.count(F.lit(1)) >= n, F.min("similarity")).otherwise(-2.0).alias("floor")
    )
    known = targets.join(floors, "target").select("target", "_vec", "floor", F.lit(n + 1).alias("first"))
    pairs = asked.select(*RING).unionByName(visits(known, chosen, rings, None).select(*RING))
    looked_at = pairs.join(table, RING).agg(F.sum("items")).first()[0]
    return 1 - looked_at / (targets.count() * groups.count())
