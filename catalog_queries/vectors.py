"""Similarity, recommendation and vector checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog_engine import runtime
from catalog_engine.functions import text
from catalog_engine.functions import vectors as V
from catalog_engine.operators import pivots, quality, similar
from catalog_engine.plans import recommend as rec
from catalog_queries.tables import table

TARGET = 7  # the item a user has selected


def _embeddings(spark, sf) -> DataFrame:
    return table(spark, sf, "embeddings")


def _label_targets(spark, sf) -> DataFrame:
    """One target per label: its lowest vec_id."""
    first = F.min(F.struct("vec_id", "embedding"))
    return _embeddings(spark, sf).groupBy("label").agg(first.alias("r")).select("r.vec_id", "r.embedding")


def similar_top_n(spark, sf):
    top = similar.top_n_similar(_embeddings(spark, sf), "vec_id", "embedding", TARGET, 10)
    return top.select("vec_id", F.round("similarity", 6).alias("similarity"))


def similar_batch(spark, sf):
    top = similar.top_n_batch(
        _embeddings(spark, sf), _label_targets(spark, sf), "vec_id", "embedding", 5
    )
    return top.select("target", "vec_id", F.round("similarity", 6).alias("similarity"), "rank")


def similar_pivots(spark, sf):
    """The same by groups around pivots."""
    top = pivots.top_n_pivots(
        _embeddings(spark, sf), _label_targets(spark, sf), "vec_id", "embedding", 5, pivots=32
    )
    return top.select("target", "vec_id", F.round("similarity", 6).alias("similarity"), "rank")


def similar_mixed(spark, sf):
    """Vectors of two sizes and repeated targets, in one block of targets and in many: the same answers."""
    half = F.when(F.col("label") < 5, F.slice("embedding", 1, 32)).otherwise(F.col("embedding"))
    items = _embeddings(spark, sf).select("vec_id", half.alias("embedding"))
    targets = items.join(_label_targets(spark, sf).select("vec_id"), "vec_id", "left_semi")
    targets = targets.unionByName(targets)
    found = [
        similar.top_n_batch(items, targets, "vec_id", "embedding", 5, max_bytes=size).withColumn("blocks", F.lit(name))
        for name, size in (("one", runtime.BROADCAST_BYTES), ("many", 2048))
    ]
    both = found[0].unionByName(found[1])
    return both.select("blocks", "target", "vec_id", F.round("similarity", 6).alias("similarity"), "rank")


def recommend_join(spark, sf):
    emb = _embeddings(spark, sf)
    out = rec.recommend(emb, emb, TARGET, 5, "vec_id", "embedding", ["label"])
    return out.select("vec_id", F.round("similarity", 6).alias("similarity"), "label")


def recommend_left(spark, sf):
    items = table(spark, sf, "labels").withColumnRenamed("doc_id", "vec_id")
    out = rec.recommend(items, _embeddings(spark, sf), TARGET, 10, "vec_id", "embedding", how="left")
    numbers = [F.col(c).cast("double").alias(c) for c in ("quality", "toxic")]
    return out.select("vec_id", F.round("similarity", 6).alias("similarity"), *numbers)


def recommend_batch(spark, sf):
    emb = _embeddings(spark, sf)
    targets = emb.groupBy("label").agg(F.max("vec_id").alias("vec_id"))
    out = rec.recommend_batch(emb, emb, targets, 3, "vec_id", "embedding", ["label"])
    return out.select("target", "vec_id", F.round("similarity", 6).alias("similarity"), "rank", "label")


def vector_norms(spark, sf):
    return _embeddings(spark, sf).select(
        "vec_id", F.round(V.norm("embedding"), 6).alias("norm"), F.cardinality("embedding").alias("dims")
    )


def vector_cosine(spark, sf):
    """Every vector against the first one that carries its label."""
    first = F.min(F.struct("vec_id", "embedding"))
    heads = _embeddings(spark, sf).groupBy("label").agg(first["embedding"].alias("head"))
    return _embeddings(spark, sf).join(heads, "label").select(
        "vec_id", F.round(V.cosine("embedding", "head"), 6).alias("similarity")
    )


def display_fields(spark, sf):
    emb = _embeddings(spark, sf)
    out = rec.recommend(emb, emb, TARGET, 10, "vec_id", "embedding", ["label"])
    return out.select(
        text.display_label(F.col("vec_id").cast("string"), F.col("label").cast("string")).alias("caption"),
        F.round("similarity", 3).alias("similarity"),
    )


def dims(spark, sf):
    return quality.check_dims(_embeddings(spark, sf), "embedding", 64)


def counts(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id")
    emb = _embeddings(spark, sf).withColumnRenamed("vec_id", "doc_id")
    joined = docs.join(emb, "doc_id", "left")
    return joined.agg(
        F.count(F.lit(1)).alias("items"),
        F.count("embedding").alias("embedded"),
        F.min(F.cardinality("embedding")).alias("min_dim"),
    )


def missing_targets(spark, sf):
    targets = table(spark, sf, "documents").select(F.col("doc_id").alias("vec_id"))
    return similar.missing_targets(targets, _embeddings(spark, sf), "vec_id", "embedding")


QUERIES = {
    f.__name__: f
    for f in (
        similar_top_n, similar_batch, similar_pivots, similar_mixed, recommend_join, recommend_left, recommend_batch,
        vector_norms, vector_cosine, display_fields, dims, counts, missing_targets,
    )
}

_COS = "round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9)"


def _top(n: int) -> str:
    return f"""top AS (
  SELECT a.vec_id, {_COS} AS sim FROM embeddings a, embeddings b
  WHERE b.vec_id = {TARGET} AND a.vec_id <> {TARGET} ORDER BY sim DESC, a.vec_id LIMIT {n})"""


def _batch(pick: str, n: int) -> str:
    return f"""targets AS (SELECT {pick}(vec_id) AS vec_id FROM embeddings GROUP BY label),
top AS (
  SELECT b.vec_id AS target, a.vec_id, {_COS} AS sim
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE b.vec_id IN (SELECT vec_id FROM targets)),
ranked AS (
  SELECT target, vec_id, round(sim, 6) AS similarity,
    CAST(row_number() OVER (PARTITION BY target ORDER BY sim DESC, vec_id) AS INT) AS rank
  FROM top QUALIFY rank <= {n})"""


SQL = {
    "similar_top_n": f"WITH {_top(10)} SELECT vec_id, round(sim, 6) AS similarity FROM top",
    "similar_batch": f"WITH {_batch('min', 5)} SELECT * FROM ranked",
    "similar_pivots": f"WITH {_batch('min', 5)} SELECT * FROM ranked",
    "similar_mixed": f"""WITH items AS (
  SELECT vec_id, label, CASE WHEN label < 5 THEN embedding[1:32] ELSE embedding END AS embedding FROM embeddings),
targets AS (SELECT min(vec_id) AS vec_id FROM embeddings GROUP BY label),
top AS (
  SELECT b.vec_id AS target, a.vec_id, CASE WHEN len(a.embedding) = len(b.embedding) THEN {_COS} END AS sim
  FROM items a JOIN items b ON a.vec_id <> b.vec_id WHERE b.vec_id IN (SELECT vec_id FROM targets)
    AND a.embedding IS NOT NULL AND b.embedding IS NOT NULL),
ranked AS (
  SELECT target, vec_id, round(sim, 6) AS similarity,
    CAST(row_number() OVER (PARTITION BY target ORDER BY sim DESC NULLS LAST, vec_id) AS INT) AS rank
  FROM top QUALIFY rank <= 5)
SELECT blocks, ranked.* FROM ranked, (VALUES ('one'), ('many')) b(blocks)""",
    "recommend_join": f"""WITH {_top(5)}
SELECT vec_id, round(sim, 6) AS similarity, label FROM top JOIN embeddings USING (vec_id)""",
    "recommend_left": f"""WITH {_top(10)}
SELECT vec_id, round(sim, 6) AS similarity, quality::DOUBLE AS quality, toxic::DOUBLE AS toxic FROM top LEFT JOIN labels ON doc_id = vec_id""",
    "recommend_batch": f"WITH {_batch('max', 3)} SELECT ranked.*, label FROM ranked JOIN embeddings USING (vec_id)",
    "vector_norms": """SELECT vec_id, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm,
  CAST(len(embedding) AS INT) AS dims FROM embeddings""",
    "vector_cosine": """WITH heads AS (
  SELECT * FROM embeddings WHERE vec_id IN (SELECT min(vec_id) FROM embeddings GROUP BY label))
SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity
FROM embeddings a JOIN heads b ON a.label = b.label""",
    "display_fields": f"""WITH {_top(10)}
SELECT vec_id || ' — ' || label AS caption, round(sim, 3) AS similarity FROM top JOIN embeddings USING (vec_id)""",
    "dims": """SELECT count(*) AS rows, count(embedding) AS embedded, CAST(min(len(embedding)) AS INT) AS min_dim,
  CAST(max(len(embedding)) AS INT) AS max_dim, count(*) FILTER (embedding IS NULL) AS missing,
  count(*) FILTER (len(embedding) <> 64) AS wrong_dim FROM embeddings""",
    "counts": """SELECT count(*) AS items, count(embedding) AS embedded, CAST(min(len(embedding)) AS INT) AS min_dim
FROM documents LEFT JOIN embeddings ON vec_id = doc_id""",
    "missing_targets": """SELECT doc_id AS vec_id FROM documents
WHERE doc_id NOT IN (SELECT vec_id FROM embeddings WHERE embedding IS NOT NULL)""",
}
