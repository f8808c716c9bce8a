"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog_engine import runtime


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``id, component`` of every end of a link; the component is its smallest id.

    Each round gives every id the smallest label beside it, and then the label
    of its label, so that the number of rounds grows with the logarithm of the
    longest path.  Sums and joins only; the labels are written down each round.
    """
    both = links.select(F.col(a).alias("a"), F.col(b).alias("b"))
    both = both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = runtime.checkpointed(both.filter(F.col("a") != F.col("b")).distinct())
    labels = runtime.checkpointed(
        both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("b")).select("id", F.least("id", "b").alias("component"))
    )
    while True:
        near = both.join(labels, F.col("b") == F.col("id")).groupBy("a").agg(F.min("component").alias("near"))
        nearest = labels.join(near, F.col("id") == F.col("a")).select(
            "id", F.col("component").alias("old"), F.least("component", "near").alias("component")
        )
        nearest = runtime.checkpointed(nearest)
        jump = nearest.select(F.col("id").alias("j_id"), F.col("component").alias("j_component"))
        found = nearest.join(jump, F.col("component") == F.col("j_id"), "left").select(
            "id", "old", F.least("component", F.coalesce("j_component", "component")).alias("component")
        )
        found = runtime.checkpointed(found)
        changed = found.filter(F.col("old") != F.col("component")).limit(1).count()
        labels = found.select("id", "component")
        if not changed:
            return labels
