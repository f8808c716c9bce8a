"""Add or update a batch of scraped items through all layers."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog_engine import rules, runtime
from catalog_engine import schema as schemas
from catalog_engine.functions import text
from catalog_engine.operators import changes, quality
from catalog_engine.operators.dedupe import dedupe_best
from catalog_engine.operators.encode import Model, encode
from catalog_engine.operators.extract import extract_fields, stringify
from catalog_engine.operators.html_fields import item_pages_to_raw
from catalog_engine.operators.keys import unlisted
from catalog_engine.operators.upsert import delete_by_key, delete_cascade, upsert
from catalog_engine.plans.clean import clean, item_spec
from catalog_engine.plans.embed import best_text

# What a new item knows about itself; ratings come from the bulk job.
UPSERTED = [c for c in schemas.CLEAN.names if c not in ("rating", "rating_count")]


@dataclass(frozen=True)
class Layers:
    raw: DataFrame
    clean: DataFrame
    embeddings: DataFrame


#: The raw column that every clean column is read from.
SOURCES = {rule.name: rule.source for rule in rules.ITEM_FIELDS} | {
    c: c for c in ("perfumers", "gender", "description", "url")
}

# What a row of the report says about a record.
NO_ADDRESS, NO_ID, SHARED_ID = "no address", "no id in the address", "id of another record"
NO_NUMBER, NO_TEXT = "id is not a number", "nothing to embed"
REPORT = ["url", "id", "name", "brand", "perfume_string", "status", "reason", "missing_fields", "needs_embedding"]


@dataclass(frozen=True)
class Batch:
    """Incoming records, and the clean rows made of them with their status.

    ``given`` names the raw columns that the records came with: a partial
    record changes these only.
    """

    records: DataFrame
    judged: DataFrame
    given: tuple[str, ...]

    @property
    def status(self) -> DataFrame:
        """The accepted rows."""
        return self.judged.filter(F.col("status") != changes.REJECTED)

    @property
    def report(self) -> DataFrame:
        """One row per incoming record, rejected ones too."""
        return self.judged.select(*REPORT)

    @property
    def raw_cols(self) -> dict:
        """How the raw layer is merged: whole records replace stored ones."""
        if len(self.given) == len(schemas.RAW.names):
            return {}
        return {"update_cols": [c for c in self.given if c != "url"], "insert_cols": list(self.given)}

    @property
    def clean_cols(self) -> dict:
        derived = [c for c in UPSERTED if SOURCES.get(c, "url") in self.given]
        return {"update_cols": [c for c in derived if c != "id"], "insert_cols": derived}


@dataclass(frozen=True)
class Ingested:
    layers: Layers
    status: DataFrame


def prepare(incoming: DataFrame, layers: Layers) -> Batch:
    """Extract and classify ``incoming``: one scraped record per URL.

    Columns that ``incoming`` lacks keep their stored values; the address and
    what the tag bag is made of must be there.  Every record has a row in the
    result: records without an address or id, and all but one of those whose
    addresses carry the same id, are ``rejected`` with a reason and reach the
    raw layer only.

    Records, their fields and status are written down here, before any layer changes:
    the pages are parsed and fields extracted once, and all that follows depends on
    what the layers held until now.
    """
    given = tuple(c for c in schemas.RAW.names if c in incoming.columns)
    lacking = {"url", "main_accords", "description"} - set(given)
    if lacking:
        raise ValueError(f"records need the columns {', '.join(sorted(lacking))}")
    records = runtime.written(stringify(incoming, schemas.RAW.names))
    unknown = quality.unknown_fields([c for c in given if c != "url"]).alias("missing_fields")
    preset = item_spec(copies=False)
    preset = replace(preset, extra=(*preset.extra, unknown))

    extracted = clean(records.filter(F.col("url").isNotNull()), preset).select(*UPSERTED, "missing_fields")
    extracted = runtime.checkpointed(extracted)
    named = extracted.filter(F.col("id").isNotNull())
    # Two addresses can carry one id; the last address stands for it.
    accepted = dedupe_best(named, ["id"], [F.desc("url")])
    stored = layers.embeddings.select(F.col("id").cast("string").alias("id"), "perfume_string")
    accepted = changes.classify_changes(accepted, layers.clean, stored, "id", "perfume_string")
    why = F.when(text.to_key("id").isNull(), NO_NUMBER).when(F.col("perfume_string") == "", NO_TEXT)
    accepted = accepted.withColumn("reason", F.when(F.col("needs_embedding"), why))
    accepted = accepted.withColumn("needs_embedding", F.col("needs_embedding") & F.col("reason").isNull())

    def rejected(rows: DataFrame, reason: str) -> DataFrame:
        return rows.select(
            "*", F.lit(changes.REJECTED).alias("status"), F.lit(reason).alias("reason"), F.lit(False).alias("needs_embedding")
        )

    others = unlisted(named, dedupe_best(named.select("id", "url"), ["id"], [F.desc("url")]), "url")
    nowhere = extract_fields(records.filter(F.col("url").isNull()), preset.fields, preset.extra)
    judged = (
        accepted.unionByName(rejected(others, SHARED_ID))
        .unionByName(rejected(extracted.filter(F.col("id").isNull()), NO_ID))
        .unionByName(rejected(nowhere, NO_ADDRESS), allowMissingColumns=True)
        .select(*UPSERTED, "missing_fields", "status", "reason", "needs_embedding")
    )
    return Batch(records, runtime.written(judged), given)


def vectors(status: DataFrame, encoder: Callable[[], Model]) -> DataFrame:
    """Vectors of the rows whose status asks for one, written down: the encoder runs once."""
    flagged = status.filter(F.col("needs_embedding")).select(
        text.to_key("id").alias("id"), "perfume_string", "url"
    )
    ready = changes.rows_with_text(flagged, "id", "perfume_string")
    # Different texts can be one number.
    ready = dedupe_best(ready, ["id"], best_text("perfume_string", "url")).drop("url")
    return runtime.written(encode(ready, "perfume_string", encoder))


def ingest(incoming: DataFrame, layers: Layers, encoder: Callable[[], Model]) -> Ingested:
    """New states of all layers, and a status per incoming record."""
    batch = prepare(incoming, layers)
    raw = upsert(layers.raw, batch.records, "url", **batch.raw_cols)
    clean_rows = upsert(layers.clean, batch.status, "id", **batch.clean_cols, null_keys=False)
    embeddings = upsert(
        layers.embeddings,
        vectors(batch.status, encoder),
        "id",
        update_cols=["perfume_string", "embedding"],
        insert_cols=["id", "perfume_string", "embedding"],
        null_keys=False,
    )
    return Ingested(Layers(raw, clean_rows, embeddings), batch.report)


def ingest_pages(
    pages: DataFrame, layers: Layers, encoder: Callable[[], Model], url: str = "url", html: str = "html"
) -> Ingested:
    """The same from item pages: parse, extract, classify, merge and embed in one run."""
    return ingest(item_pages_to_raw(pages, url, html), layers, encoder)


def entered(forms: DataFrame) -> DataFrame:
    """Records typed in by hand: ``main_accords`` is pasted text, one entry a line.

    Address, entries, prose and category are all that such a record knows.
    """
    return forms.select("url", text.lines_to_array("main_accords").alias("main_accords"), "description", "gender")


def remove(keys: DataFrame, layers: Layers) -> Layers:
    """All layers without the listed items; ``keys`` holds id and url."""
    left = delete_cascade({"raw": (layers.raw, "url"), "clean": (layers.clean, "id")}, keys)
    numeric = keys.select(text.to_key("id").alias("id"))
    return Layers(left["raw"], left["clean"], delete_by_key(layers.embeddings, numeric, "id"))
