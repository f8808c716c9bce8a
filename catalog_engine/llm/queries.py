"""Registered queries of this package: each operator over its whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog_engine import runtime
from catalog_engine.llm import (
    chat,
    html_paths,
    itq,
    mix,
    multi_index,
    near,
    orchard,
    pieces,
    pii,
    quality,
    source_audit,
    tokens,
    warc,
)


def _table(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def op1_multi_index(spark, sf):
    """The 10 nearest of every vector whose id is divisible by 100."""
    vectors = _table(spark, sf, "embeddings")
    return multi_index.nearest(vectors, vectors.filter(F.col("vec_id") % 100 == 0), top=10)


def op2_sentencepiece(spark, sf):
    """All documents as piece ids, and whether the ids decode to the text."""
    return pieces.encode(_table(spark, sf, "documents"))


def op3_quality(spark, sf):
    """A quality score of every document, learned from the labels that are not held out."""
    docs = _table(spark, sf, "documents")
    table, network = quality.fit(docs, _table(spark, sf, "labels"), holdout=True)
    return quality.score(docs, table, network).select(
        "doc_id",
        quality.held_out("doc_id").alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )


def op4_warc(spark, sf):
    """Every page archived and read back."""
    path = runtime.scratch_path(spark, "warc")
    warc.write_archives(_table(spark, sf, "pages"), path)
    return warc.read_archives(spark, path).select(
        F.col("key").try_cast("bigint").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.col("refers_to").try_cast("bigint").alias("refers_to"),
    )


def op5_dart_minhash(spark, sf):
    """The near-duplicate class of every document."""
    return near.near_duplicates(_table(spark, sf, "documents"))


def op6_pii(spark, sf):
    """Personal data in every document."""
    return pii.find_pii(_table(spark, sf, "documents")).select(
        "doc_id",
        *(pii.count_of(kind).alias(f"n_{kind}") for kind in pii.BASE),
        F.sha2(pii.joined(pii.BASE), 256).alias("base_sha256"),
        pii.joined(pii.KINDS).alias("spans"),
        pii.scores().alias("scores"),
    )


def op7_mix(spark, sf):
    """How often the mix takes every document."""
    return mix.mix_report(_table(spark, sf, "documents"))


def op8_itq(spark, sf):
    """Links and components of all vectors."""
    return itq.near_vectors(_table(spark, sf, "embeddings"))


def op9_token_counts(spark, sf):
    """Tokens of every document."""
    return tokens.count_tokens(_table(spark, sf, "documents"))


def op10_main_text(spark, sf):
    """The main text of every page."""
    return html_paths.extract_main_text(_table(spark, sf, "pages"))


def op11_source_audit(spark, sf):
    """How the sources of each language differ, and by which terms."""
    return source_audit.audit(_table(spark, sf, "documents"))


def op12_orchard(spark, sf):
    """Clusters of all vectors of 64 components."""
    return orchard.clusters(_table(spark, sf, "embeddings"))


def op13_chat(spark, sf):
    """Every conversation formatted, written, read again and parsed."""
    path = runtime.scratch_path(spark, "chat")
    formatted = chat.format_conversations(chat.with_sample(_table(spark, sf, "conversations")))
    formatted.write.option("compression", "zstd").parquet(path)
    return chat.digests(spark.read.parquet(path)).select(F.col("conv").alias("conv_id"), *chat.DIGEST)


QUERIES = {
    q.__name__: q
    for q in (
        op1_multi_index,
        op2_sentencepiece,
        op3_quality,
        op4_warc,
        op5_dart_minhash,
        op6_pii,
        op7_mix,
        op8_itq,
        op9_token_counts,
        op10_main_text,
        op11_source_audit,
        op12_orchard,
        op13_chat,
    )
}

SQL = {
    "op7_mix": mix.SQL,
    "op11_source_audit": source_audit.SQL,
    "op12_orchard": orchard.SQL,
    "op13_chat": chat.SQL,
}
