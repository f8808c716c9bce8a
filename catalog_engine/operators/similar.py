"""Cosine top-N for one target, or for a table of targets."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from catalog_engine import runtime
from catalog_engine.operators import pairing
from catalog_engine.operators.keys import listed, unlisted

# Similarities are compared to this many decimals, then by key, so that equal
# vectors rank alike whatever order their products were summed in.
DECIMALS = 9


def top_n_similar(df: DataFrame, key: str, vec: str, target, n: int) -> DataFrame:
    """The ``n`` rows nearest to one target, as (key, similarity), nearest first.

    The target's own rows are left out before the limit.  Raises ValueError
    when the target has no vector.
    """
    vecs = df.select(F.col(key), F.col(vec).alias("_vec")).filter(F.col("_vec").isNotNull())
    # Of copies that differ the smallest vector asks.
    one = vecs.filter(F.col(key) == F.lit(target)).orderBy("_vec").limit(1).withColumnRenamed(key, "target").toArrow()
    if not one.num_rows:
        raise ValueError(f"{key} {target!r} has no vector")
    scored = pairing.score_with(
        vecs.filter(F.col(key) != F.lit(target)), one, lambda block: _Nearest(block, key, n), _schema(df, key, key)
    )
    return (
        scored.select(key, "similarity").orderBy(F.desc_nulls_last("similarity"), key).limit(n)
    )


def _schema(df: DataFrame, key: str, target_key: str, targets: DataFrame | None = None) -> str:
    target_type = (targets if targets is not None else df).schema[target_key].dataType.simpleString()
    return f"target {target_type}, `{key}` {df.schema[key].dataType.simpleString()}, similarity double"


def top_n_batch(
    items: DataFrame,
    targets: DataFrame,
    key: str,
    vec: str,
    n: int,
    target_key: str | None = None,
    max_bytes: int = runtime.BROADCAST_BYTES,
) -> DataFrame:
    """The ``n`` nearest items of every target, as (target, key, similarity, rank).

    ``targets`` holds a key and a vector column.  Each task keeps a running
    top-N per target, so what is shuffled is targets x tasks x N small rows.
    A target listed more than once counts once, with the smallest of its
    vectors.  Vectors of different sizes have NULL similarity, whatever else is listed.
    """
    target_key = target_key or key
    items = items.select(F.col(key), F.col(vec).alias("_vec")).filter(
        F.col("_vec").isNotNull() & F.col(key).isNotNull()
    )
    targets = targets.select(F.col(target_key).alias("target"), F.col(vec).alias("_vec")).filter(
        F.col("_vec").isNotNull()
    )
    targets = targets.groupBy("target").agg(F.min("_vec").alias("_vec"))
    row_bytes = F.size("_vec") * 8 + 64
    scored = pairing.score_blocks(
        items,
        targets,
        lambda block: _Nearest(block, key, n),
        _schema(items, key, "target", targets),
        row_bytes,
        max_bytes,
    )
    best = Window.partitionBy("target").orderBy(F.desc_nulls_last("similarity"), key)
    return scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= n)


def missing_targets(targets: DataFrame, items: DataFrame, key: str, vec: str, target_key: str | None = None) -> DataFrame:
    """Targets that have no vector, so no neighbours (the batch form of the missing-target error)."""
    embedded = items.filter(F.col(vec).isNotNull()).select(F.col(key).alias(target_key or key))
    return unlisted(targets, embedded, target_key or key)


def attach(top: DataFrame, items: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Attributes for a top-N list (J3); ``how="left"`` keeps ids without a row.

    For the left form the items are first cut down to the listed keys, so the
    big table is on the streamed side of a join with the short list.
    """
    if how == "left":
        items = listed(items, top, key)
    return top.join(items, key, how)


class _Nearest:
    """Running top-N per target over blocks of items."""

    def __init__(self, targets: pa.Table, key: str, n: int):
        self.key, self.n = key, n
        self.target_type = targets.schema.field("target").type
        self.ids = targets.column("target").to_pandas()
        vecs = targets.column("_vec")
        sizes = vecs.combine_chunks().value_lengths().to_numpy(zero_copy_only=False)
        #: For each vector size the targets that have it, and their unit rows.
        self.by_size = [
            (int(size), at, _unit_rows(vecs.take(pa.array(at)), int(size)))
            for size in np.unique(sizes)
            for at in [np.flatnonzero(sizes == size)]
        ]
        self.places = pd.Index(self.ids)
        self.best: pd.DataFrame | None = None
        self.key_type = pa.null()

    def add(self, block: pa.Table) -> None:
        self.key_type = block.schema.field(self.key).type
        if not block.num_rows or not len(self.ids):
            return
        keys = block.column(self.key).to_pandas().to_numpy()
        # The target that an item is itself, -1 for none.
        own = self.places.get_indexer(keys)
        found = [self.best] if self.best is not None else []
        for size, at, matrix in self.by_size:
            rows = _unit_rows(block.column("_vec"), size)
            step = max(1, (1 << 22) // len(keys))
            for start in range(0, len(at), step):
                asked = at[start : start + step]
                sims = np.round(matrix[start : start + step] @ rows.T, DECIMALS)
                sims[np.isnan(sims)] = -2.0  # no direction or another size: after every real similarity
                itself = np.searchsorted(asked, own)
                here = np.flatnonzero((own >= 0) & (itself < len(asked)) & (asked[np.minimum(itself, len(asked) - 1)] == own))
                sims[itself[here], here] = -np.inf
                if sims.shape[1] > self.n:
                    floor = np.partition(sims, -self.n, axis=1)[:, -self.n][:, None]
                else:
                    floor = np.full((len(sims), 1), -2.0)
                t, i = np.nonzero((sims >= floor) & (sims > -np.inf))
                found.append(pd.DataFrame({"t": asked[t], "key": keys[i], "similarity": sims[t, i]}))
        ranked = pd.concat(found).sort_values(["t", "similarity", "key"], ascending=[True, False, True])
        self.best = ranked.groupby("t").head(self.n)

    def result(self) -> pa.Table:
        best = self.best if self.best is not None else pd.DataFrame({"t": [], "key": [], "similarity": []})
        sims = best["similarity"].to_numpy(dtype=float)
        return pa.table(
            {
                "target": pa.array(self.ids.iloc[best["t"].astype(int)], type=self.target_type),
                self.key: pa.array(best["key"], type=self.key_type),
                "similarity": pa.array(sims, mask=sims < -1.5, type=pa.float64()),
            }
        )


def _unit_rows(vecs: pa.ChunkedArray, dim: int) -> np.ndarray:
    """Vectors as a matrix of unit rows; NaN where a row has no direction or another size."""
    arr = vecs.combine_chunks()
    sizes = arr.value_lengths().to_numpy(zero_copy_only=False)
    fits = sizes == dim
    if not dim:
        # A vector without components has no direction.
        return np.full((len(sizes), 1), np.nan)
    out = np.full((len(sizes), dim), np.nan)
    if fits.all():
        out = arr.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(sizes), dim)
    elif fits.any():
        out[fits] = arr.filter(pa.array(fits)).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
    with np.errstate(divide="ignore", invalid="ignore"):
        return out / np.linalg.norm(out, axis=1, keepdims=True)
