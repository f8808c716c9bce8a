"""Score a large table against a request table, keeping only the best rows.

The reducing work is done by a *kernel*: an object built from a block of
request rows, fed with blocks of the large table, and asked for its result at
the end.  No pair of rows ever exists as a row of a DataFrame.

Requests are packed into blocks of bounded, measured size, one row each, and meet
the large table by a join.  A few of them are one block, which joins the
first row of every partition of the large table: a broadcast join, by which no
row of the large table moves.  More of them are numbered blocks; then the rows
of the large table go, in groups, to every block, and stream past it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalog_engine import runtime

REQUESTS, BLOCK, GROUP = "__requests", "__block", "__group"
#: Rows of a partition are numbered in the lower 33 bits of their id.
IN_PARTITION = (1 << 33) - 1


class Kernel(Protocol):
    def add(self, block: pa.Table) -> None: ...

    def result(self) -> pa.Table: ...


def score_blocks(
    left: DataFrame,
    right: DataFrame,
    kernel: Callable[[pa.Table], Kernel],
    schema: str,
    right_bytes: Column,
    max_bytes: int = runtime.BROADCAST_BYTES,
) -> DataFrame:
    """Rows of ``kernel(request block)`` fed with blocks of ``left``.

    ``right_bytes`` estimates one request's size.  The requests are written
    down first, so that finding them is done once.  Of what is measured only
    two numbers come to the driver.  A kernel may see all of ``left`` or a part
    of it, so results are to be merged.
    """
    right = runtime.checkpointed(right)
    rows, total = right.agg(F.count(F.lit(1)), F.coalesce(F.sum(right_bytes), F.lit(0))).first()
    if total <= max_bytes:
        return _beside(left, packed(right, 1), kernel, schema)
    return _dealt(left, right, min(rows, -(-int(total) // max_bytes)), kernel, schema)


def packed(right: DataFrame, blocks: int) -> DataFrame:
    """``__block, __requests``: the rows in so many blocks, each packed into one value.

    Blocks are dealt by row positions, so no key can make one large.
    """
    number = F.pmod(F.monotonically_increasing_id(), F.lit(blocks)).cast("int")
    dealt = right.withColumn(BLOCK, number).repartition(blocks, BLOCK).sortWithinPartitions(BLOCK)
    names = right.columns

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = None, []
        for batch in batches:
            numbers = batch.column(BLOCK).to_numpy()
            cuts = [0, *(np.flatnonzero(numbers[1:] != numbers[:-1]) + 1).tolist(), len(numbers)]
            for start, end in zip(cuts[:-1], cuts[1:]):
                if start == end:
                    continue
                if held and numbers[start] != block:
                    yield _packed_row(block, held)
                    held = []
                block = int(numbers[start])
                held.append(batch.select(names).slice(start, end - start))
        if held:
            yield _packed_row(block, held)

    return dealt.mapInArrow(pack, f"{BLOCK} int, {REQUESTS} binary")


def _packed_row(block: int, rows: list[pa.RecordBatch]) -> pa.RecordBatch:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows[0].schema) as writer:
        for batch in rows:
            writer.write_batch(batch)
    return pa.RecordBatch.from_arrays(
        [pa.array([block], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], [BLOCK, REQUESTS]
    )


def _scan(kernel: Callable[[pa.Table], Kernel], names: list[str], dealt: bool):
    """Rows that carry requests start a new kernel; all others are shown to it.

    Rows that are ``dealt`` have the number of their block and group, and a row that
    carries requests is nothing else; a block that got no request shows its rows to none.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, at, requests = None, None, None
        for batch in batches:
            carried = batch.column(REQUESTS)
            starts = np.asarray(carried.is_valid())
            where = batch.column(GROUP).to_numpy() if dealt else np.zeros(batch.num_rows, np.int64)
            starts[1:] |= where[1:] != where[:-1]
            starts[:1] |= where[:1] != at
            items = pa.Table.from_batches([batch.select(names)])
            heads = np.flatnonzero(starts).tolist()
            cuts = [*([] if heads[:1] == [0] else [0]), *heads, batch.num_rows]
            for start, end in zip(cuts[:-1], cuts[1:]):
                if start < end and starts[start]:
                    if k is not None:
                        yield from k.result().to_batches()
                    k, at, requests = None, where[start], None
                    if carried[start].is_valid:
                        requests = pa.ipc.open_stream(carried[start].as_buffer()).read_all()
                        start += dealt
                if requests is not None and start < end:
                    k = k or kernel(requests)
                    k.add(items.slice(start, end - start))
        if k is not None:
            yield from k.result().to_batches()

    return scan


def _beside(left: DataFrame, block: DataFrame, kernel: Callable[[pa.Table], Kernel], schema: str) -> DataFrame:
    """One block of requests, beside the first row of every partition of ``left``."""
    first = F.monotonically_increasing_id().bitwiseAND(F.lit(IN_PARTITION)) == 0
    marked = left.withColumn(BLOCK, F.when(first, F.lit(0)))
    joined = marked.join(F.broadcast(block), BLOCK, "left").drop(BLOCK)
    return joined.mapInArrow(_scan(kernel, left.columns, dealt=False), schema)


def _dealt(left: DataFrame, right: DataFrame, blocks: int, kernel: Callable[[pa.Table], Kernel], schema: str) -> DataFrame:
    """Numbered blocks of requests, each met by all groups of ``left``.

    There are as many groups as make a task of each for every shuffle
    partition; a group streams past its block and is never held.
    """
    spark = left.sparkSession
    groups = max(1, -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // blocks))
    items = left.withColumn(GROUP, F.pmod(F.monotonically_increasing_id(), F.lit(groups)).cast("int"))
    items = items.withColumn(BLOCK, F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    requests = packed(right, blocks).withColumn(GROUP, F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    both = requests.unionByName(items, allowMissingColumns=True)
    dealt = both.repartition(blocks * groups, BLOCK, GROUP)
    ordered = dealt.withColumn(GROUP, F.col(BLOCK).cast("long") * groups + F.col(GROUP)).drop(BLOCK)
    ordered = ordered.sortWithinPartitions(GROUP, F.col(REQUESTS).isNull())
    return ordered.mapInArrow(_scan(kernel, left.columns, dealt=True), schema)


def score_with(left: DataFrame, requests: pa.Table, kernel: Callable[[pa.Table], Kernel], schema: str) -> DataFrame:
    """The same for a few requests the driver already holds."""
    shipped = left.sparkSession.sparkContext.broadcast(requests)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = None
        for batch in batches:
            k = k or kernel(shipped.value)
            k.add(pa.Table.from_batches([batch]))
        if k is not None:
            yield from k.result().to_batches()

    return left.mapInArrow(scan, schema)
