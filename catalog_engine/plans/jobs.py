"""The jobs over stored tables: read, compute, publish, report counts."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalog_engine import runtime
from catalog_engine import schema as schemas
from catalog_engine.functions import text
from catalog_engine.operators.encode import Model
from catalog_engine.operators.keys import listed
from catalog_engine.operators.upsert import delete_by_key, insert_rows, upsert
from catalog_engine.plans import embed as embedding
from catalog_engine.plans import ingest as ingesting
from catalog_engine.plans.clean import clean_items
from catalog_engine.sources import partitions as hashed
from catalog_engine.sources import tables


@dataclass(frozen=True)
class Table:
    """A published table: whole versions, or ``partitions`` by a hash of the key."""

    root: str
    schema: T.StructType
    key: str
    partitions: int | None = None

    def read(self, spark: SparkSession) -> DataFrame:
        if self.partitions:
            return hashed.read(spark, self.root, self.schema, self.partitions)
        return tables.read_current(spark, self.root, self.schema)

    def publish(self, df: DataFrame) -> int:
        """``df`` as the table's content; returns its rows."""
        if self.partitions:
            return hashed.overwrite(df, self.root, self.key, self.partitions)
        return tables.publish(df, self.root)

    def append(self, df: DataFrame) -> int:
        if self.partitions:
            return hashed.append(df, self.root, self.key, self.partitions)
        return tables.append(df, self.root)

    def _change(self, spark: SparkSession, keys: DataFrame, new: Callable[[DataFrame], DataFrame]) -> None:
        """Publish ``new`` of the table, or of those of its partitions that the keys meet."""
        if not self.partitions:
            self.publish(new(self.read(spark)))
            return
        met = hashed.met_by(keys, self.key, self.partitions)
        if met:
            state = hashed.read(spark, self.root, self.schema, self.partitions, met)
            hashed.overwrite(new(state), self.root, self.key, self.partitions, met)

    def merge(
        self,
        target: DataFrame,
        source: DataFrame,
        update_cols: Sequence[str] | None = None,
        insert_cols: Sequence[str] | None = None,
    ) -> None:
        """Merge ``source`` into the table, whose present state is ``target``.

        While no key is stored yet, the rows are appended and nothing is rewritten.
        ``source`` should be written down already; it is read several times.
        """
        if listed(target.select(self.key), source, self.key).isEmpty():
            self.append(insert_rows(target, source, self.key, insert_cols))
        else:
            self._change(
                source.sparkSession, source, lambda state: upsert(state, source, self.key, update_cols, insert_cols)
            )

    def remove(self, spark: SparkSession, keys: DataFrame) -> None:
        """Delete the listed keys."""
        self._change(spark, keys.filter(F.col(self.key).isNotNull()), lambda state: delete_by_key(state, keys, self.key))


@dataclass(frozen=True)
class Store:
    """Roots of the three published tables, and the number of their partitions by key, if any.

    Partitions are for batches that are small beside the tables: a batch rewrites those it meets only.
    """

    raw: str
    clean: str
    embeddings: str
    partitions: int | None = None

    @property
    def raw_table(self) -> Table:
        return Table(self.raw, schemas.RAW, "url", self.partitions)

    @property
    def clean_table(self) -> Table:
        return Table(self.clean, schemas.CLEAN, "id", self.partitions)

    @property
    def embeddings_table(self) -> Table:
        return Table(self.embeddings, schemas.EMBEDDINGS, "id", self.partitions)

    def read(self, spark: SparkSession) -> ingesting.Layers:
        return ingesting.Layers(
            self.raw_table.read(spark), self.clean_table.read(spark), self.embeddings_table.read(spark)
        )


def run_clean(spark: SparkSession, store: Store, csv_path: str | None = None) -> int:
    """Rebuild the clean table from the raw one (P1); returns its row count."""
    rows = store.clean_table.publish(clean_items(store.raw_table.read(spark)))
    if csv_path:
        tables.write_csv(store.clean_table.read(spark), csv_path)
    return rows


def run_embed(spark: SparkSession, store: Store, encoder: Callable[[], Model], mode: str = "new") -> int:
    """Embed what is new, or new and changed (P2, P3); returns the rows encoded."""
    layers = store.read(spark)
    fresh = embedding.new_embeddings(layers.clean, layers.embeddings, encoder, mode, prefer="url")
    if mode == "new":
        return store.embeddings_table.append(fresh)
    # Written down first, so that the encoder runs once.
    fresh = runtime.written(fresh)
    rows = fresh.count()
    if rows:
        columns = ["perfume_string", "embedding"]
        store.embeddings_table.merge(layers.embeddings, fresh, columns, ["id", *columns])
    return rows


def run_ingest(spark: SparkSession, store: Store, incoming: DataFrame, encoder: Callable[[], Model]) -> DataFrame:
    """Add or update scraped records in all tables (P6); returns the status per record."""
    layers = store.read(spark)
    batch = ingesting.prepare(incoming, layers)
    store.raw_table.merge(layers.raw, batch.records, **batch.raw_cols)
    store.clean_table.merge(layers.clean, batch.status, **batch.clean_cols)
    vectors = ingesting.vectors(batch.status, encoder)
    if not vectors.isEmpty():
        columns = ["perfume_string", "embedding"]
        store.embeddings_table.merge(layers.embeddings, vectors, columns, ["id", *columns])
    return batch.report


def run_remove(spark: SparkSession, store: Store, keys: DataFrame) -> None:
    """Delete the listed items (id, url) from all tables (M3)."""
    keys = runtime.written(keys.select("id", "url").distinct())
    store.embeddings_table.remove(spark, keys.select(text.to_key("id").alias("id")))
    store.clean_table.remove(spark, keys)
    store.raw_table.remove(spark, keys)
