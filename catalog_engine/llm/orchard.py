"""Clustering by centroids with Orchard's search, in whole numbers.

Every centroid has the list of the others by distance from it.  A vector starts
at some centroid and walks down that list: a centroid closer to the vector than
the best so far takes over, with its own list from the start; centroids seen
before are skipped; the walk stops at a centroid strictly more than twice as far
from the best one as the vector is, since none behind it can be as close.

Each round is one scan of the vectors: tasks send the sums of their clusters,
and the driver holds no more than ``k`` centroids.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog_engine import runtime
from catalog_engine.llm.common import arrow_schema
from catalog_engine.llm.vectors_in import by_size

K, ROUNDS, COMPONENTS, SCALE, SEED = 8, 10, 64, 1024, "3"
#: Rows at once, of which the differences are held.
ROWS = 8192


def largest(components: int) -> int:
    """Whole components up to this surely have squared distances that 64 bits hold."""
    return math.isqrt((2**63 - 1) // (4 * max(1, components)))


def whole(vectors: np.ndarray) -> np.ndarray:
    """Components as floor(SCALE * x)."""
    scaled, most = np.floor(vectors * SCALE), largest(vectors.shape[-1])
    if scaled.size and np.abs(scaled).max() > most:
        raise ValueError(f"components beyond {most / SCALE:.0f} need not have exact 64-bit distances")
    return scaled.astype(np.int64)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a - b
    return np.einsum("ij,ij->i", d, d)


class Orchard:
    """Nearest centroid by walks along lists of neighbours; ties go to the smaller number."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        k = len(centroids)
        between = np.stack([squared(centroids, c[None, :]) for c in centroids])
        #: For each centroid the others, nearest first, and how far they are.
        order = np.argsort(between, axis=1, kind="stable")
        self.lists = np.stack([row[row != i] for i, row in enumerate(order)]) if k > 1 else np.empty((1, 0), int)
        self.far = np.take_along_axis(between, self.lists, axis=1)
        #: Distances that were computed, for measuring.
        self.looked_at = 0

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of the nearest centroid of each row, and its squared distance."""
        n, k = len(x), len(self.centroids)
        # A rough guess, from a few components, makes walks short.
        some = slice(0, 4)
        rough = [squared(x[:, some], c[None, some]) for c in self.centroids]
        best = np.argmin(np.stack(rough), axis=0) if n else np.empty(0, np.int64)
        distance = squared(x, self.centroids[best])
        seen = np.zeros((n, k), bool)
        seen[np.arange(n), best] = True
        self.looked_at += n
        place = np.zeros(n, np.int64)
        walking = np.arange(n)
        while True:
            walking = walking[place[walking] < k - 1]
            # Strictly beyond twice the distance, both squared.
            at = self.far[best[walking], place[walking]] if k > 1 else np.empty(0, np.int64)
            walking = walking[-(-at // 4) <= distance[walking]]
            if not len(walking):
                return best, distance
            candidate = self.lists[best[walking], place[walking]]
            place[walking] += 1
            new = ~seen[walking, candidate]
            rows, candidate = walking[new], candidate[new]
            seen[rows, candidate] = True
            self.looked_at += len(rows)
            found = squared(x[rows], self.centroids[candidate])
            closer = (found < distance[rows]) | ((found == distance[rows]) & (candidate < best[rows]))
            rows, candidate = rows[closer], candidate[closer]
            best[rows], distance[rows], place[rows] = candidate, found[closer], 0


def _blocks(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            rows = batch.slice(start, ROWS)
            for _, x in by_size(rows.column(column)).values():
                yield rows, whole(x)


def kept_vectors(df: DataFrame, id_col: str, vector: str, components: int) -> DataFrame:
    """``id, v`` of the vectors with exactly so many components, none null or not finite."""
    infinite = F.lit(float("inf"))
    fit = (F.size(vector) == components) & F.forall(
        vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < infinite), F.lit(False))
    )
    return df.select(F.col(id_col).alias("id"), F.col(vector).alias("v")).filter(fit)


def first_centroids(vectors: DataFrame, k: int, seed: str) -> np.ndarray:
    """The vectors of the ``k`` smallest hashes of ``seed:id``."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("")))
    first = vectors.orderBy(F.sha2(named, 256), "v").limit(k).select(F.sha2(named, 256).alias("h"), "v")
    rows = sorted(first.collect(), key=lambda r: (r.h, r.v))
    return whole(np.asarray([r.v for r in rows], np.float64))


def fit(vectors: DataFrame, centroids: np.ndarray, rounds: int) -> np.ndarray:
    """Centroids after ``rounds`` rounds over ``vectors`` (id, v)."""
    context = vectors.sparkSession.sparkContext
    schema = "cluster int, place int, s long"
    out = arrow_schema(schema)
    for _ in range(rounds):
        shipped = context.broadcast(centroids)

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            search = Orchard(shipped.value)
            total = np.zeros_like(shipped.value)
            count = np.zeros(len(total), np.int64)
            for _, x in _blocks(batches, "v"):
                best, _ = search.nearest(x)
                for c in np.unique(best):
                    total[c] += x[best == c].sum(axis=0)
                count += np.bincount(best, minlength=len(count))
            k, size = total.shape
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(np.arange(k, dtype=np.int32), size + 1)),
                    pa.array(np.tile(np.arange(-1, size, dtype=np.int32), k)),
                    pa.array(np.concatenate([count[:, None], total], axis=1).ravel()),
                ],
                schema=out,
            )

        # One row a cluster and component, whatever the number of vectors.
        parts = vectors.select("v").mapInArrow(sums, schema)
        summed = parts.groupBy("cluster", "place").agg(F.sum("s").alias("s")).collect()
        by_place = {(r.cluster, r.place): r.s for r in summed}
        moved = centroids.copy()
        for c in range(len(centroids)):
            if count := by_place.get((c, -1), 0):
                moved[c] = [by_place[c, j] // count for j in range(centroids.shape[1])]
        shipped.unpersist()
        if (moved == centroids).all():
            break
        centroids = moved
    return centroids


def clusters(
    df: DataFrame,
    id_col: str = "vec_id",
    vector: str = "embedding",
    k: int = K,
    rounds: int = ROUNDS,
    components: int = COMPONENTS,
    seed: str = SEED,
) -> DataFrame:
    """``id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of every vector that takes part.

    Vectors that are null, of another size, or hold null or non-finite
    components take no part and have no row; zero vectors do.  Rows are vectors
    of their own, repeated or not; equal ids start in the order of their
    vectors; a null id is hashed as an empty text.  Fewer than ``k`` vectors make
    so many clusters; without any the result is empty.  Other columns, whatever
    their names, are not read.  Components beyond ``largest(components) / SCALE``,
    185,363 for 64 of them, are an error.
    """
    vectors = kept_vectors(df, id_col, vector, components)
    schema = f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, cluster int, distance long"
    centroids = first_centroids(vectors, k, seed)
    if len(centroids):
        centroids = fit(vectors, centroids, rounds)
    shipped = df.sparkSession.sparkContext.broadcast(centroids)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Orchard(shipped.value) if len(shipped.value) else None
        for rows, x in _blocks(batches, "v"):
            best, distance = search.nearest(x)
            yield pa.RecordBatch.from_arrays(
                [rows.column("id"), pa.array(best.astype(np.int32)), pa.array(distance)], [id_col, "cluster", "distance"]
            )

    assigned = runtime.checkpointed(vectors.mapInArrow(assign, schema))
    inertia = {r.cluster: r.s for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    facts = [
        (c, inertia.get(c, 0), sum(inertia.values()), hashlib.sha256(",".join(map(str, row.tolist())).encode()).hexdigest())
        for c, row in enumerate(centroids)
    ]
    facts = df.sparkSession.createDataFrame(
        facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"
    )
    # At most k rows.
    return assigned.join(F.broadcast(facts), "cluster").select(
        id_col, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )


def sql(k: int = K, rounds: int = ROUNDS, components: int = COMPONENTS, scale: int = SCALE, seed: str = SEED) -> str:
    """The query's SQL: every round is a pair of named tables."""
    distance = "list_sum(list_transform(generate_series(1, len(v.e)), lambda i: (v.e[i] - c.e[i]) * (v.e[i] - c.e[i])))"
    parts = [
        f"""v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id,
        list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS e
    FROM (SELECT vec_id, embedding FROM embeddings WHERE len(embedding) = {components}
        AND len(list_filter(embedding, lambda x: isfinite(x))) = {components}))""",
        f"""c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY sha256('{seed}:' || coalesce(vec_id::VARCHAR, '')), e) - 1)::INTEGER AS c, e
    FROM v QUALIFY c < {k})""",
    ]
    for n in range(rounds + 1):
        parts.append(
            f"""a{n} AS MATERIALIZED (SELECT v.r, min(struct_pack(d := {distance}, c := c.c)) AS near FROM v, c{n} AS c GROUP BY v.r)"""
        )
        if n < rounds:
            parts.append(
                f"""c{n + 1} AS MATERIALIZED (SELECT o.c, coalesce(list(f.x ORDER BY f.i) FILTER (f.i IS NOT NULL), any_value(o.e)) AS e
    FROM c{n} AS o LEFT JOIN (
        SELECT c, i, ((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS x
        FROM (SELECT near.c AS c, unnest(v.e) AS x, unnest(generate_series(1, len(v.e))) AS i FROM v JOIN a{n} USING (r))
        GROUP BY c, i) AS f ON f.c = o.c
    GROUP BY o.c)"""
            )
    return (
        "WITH "
        + ",\n".join(parts)
        + f"""
SELECT vec_id, c.c AS cluster, near.d::BIGINT AS distance,
    (sum(near.d) OVER (PARTITION BY c.c))::BIGINT AS cluster_inertia, (sum(near.d) OVER ())::BIGINT AS inertia,
    sha256(array_to_string(c.e, ',')) AS centroid_sha256
FROM v JOIN a{rounds} USING (r) JOIN c{rounds} AS c ON c.c = near.c"""
    )


SQL = sql()
