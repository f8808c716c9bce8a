"""WARC archives with dictionary compression.

Every task trains a Zstandard dictionary on the first records it archives (at
most ``SAMPLE_BYTES`` of them), writes it as the leading skippable frame of its archive and compresses
each record into a frame of its own, so that a reader can start at any record.
The archive is written by Spark's text sink: a row is a frame, and the line
separator is an empty skippable frame, which every Zstandard reader passes over.
So archives may lie in any store that Spark writes to, a retried task replaces
what the lost one wrote, and nothing passes through local files.

Archives are read whole, one per row; the writer bounds them by dealing the
payload bytes over enough tasks.
"""

from __future__ import annotations

import base64
import hashlib
import math
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog_engine import runtime
from catalog_engine.llm.common import arrow_schema

# Zstandard's magic numbers of skippable frames; the first is the one the .warc.zst format gives dictionaries.
DICTIONARY_MAGIC = 0x184D2A5D
#: An empty skippable frame (magic 0x184D2A50, size 0).
SEPARATOR = "P*M\x18\0\0\0\0"
FRAME_MAGIC = 0xFD2FB528
SAMPLE_BYTES = 4 * 1024 * 1024
SAMPLE_RECORD_BYTES = 64 * 1024
DICTIONARY_BYTES = 64 * 1024
#: Payload bytes dealt to one archive.
ARCHIVE_BYTES = 32 * 1024 * 1024
LEVEL = 3
#: Compressed bytes given to the decompressor at a time.
READ_BYTES = 4096
DATE = "2024-01-01T00:00:00Z"


def digest(payload: bytes) -> str:
    """SHA-1 in upper-case base32, as WARC headers carry it."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(key: str, uri: str, payload: bytes, refers_to: str | None, revisit: bool) -> bytes:
    """One WARC/1.1 record.  ``key`` and ``refers_to`` go into header fields of their own,
    as percent-free base64, so that any text survives."""
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"record:{key}")
    body = b"" if revisit else payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<urn:uuid:{name}>"),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", " ".join(uri.split())),
        ("WARC-Payload-Digest", f"sha1:{digest(payload)}"),
        ("X-Record-Key", base64.b64encode(key.encode()).decode()),
        ("X-Payload-Length", str(len(payload))),
    ]
    if revisit:
        fields += [
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            ("WARC-Refers-To", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'record:{refers_to}')}>"),
            ("X-Refers-To-Key", base64.b64encode((refers_to or "").encode()).decode()),
        ]
    fields += [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(body)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode() + body + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and block of a record; raises on a broken one."""
    head, found, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not found or lines[0] != "WARC/1.1":
        raise ValueError("not a WARC/1.1 record")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    size = int(fields["Content-Length"])
    if len(rest) != size + 4 or not rest.endswith(b"\r\n\r\n"):
        raise ValueError("a record's length differs from its Content-Length")
    return fields, rest[:size]


def train(samples: list[bytes]):
    """A dictionary of the samples; one without content where they are too few or too alike to train on."""
    import zstandard

    try:
        if len(samples) >= 8:
            return zstandard.train_dictionary(DICTIONARY_BYTES, samples)
    except zstandard.ZstdError:
        pass
    return zstandard.ZstdCompressionDict(b"".join(samples)[:DICTIONARY_BYTES], dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def frames(records: Iterator[bytes], level: int = LEVEL) -> Iterator[bytes]:
    """The frames of one archive: its dictionary, then one per record."""
    import zstandard

    held, size = [], 0
    for data in records:
        held.append(data)
        size += len(data)
        if size >= SAMPLE_BYTES:
            break
    if not held:
        return
    dictionary = train([r[:SAMPLE_RECORD_BYTES] for r in held])
    content = dictionary.as_bytes()
    yield struct.pack("<II", DICTIONARY_MAGIC, len(content)) + content
    compressor = zstandard.ZstdCompressor(level=level, dict_data=dictionary, write_checksum=True)
    for data in held:
        yield compressor.compress(data)
    held.clear()
    for data in records:
        yield compressor.compress(data)


def read_archive(data: bytes) -> Iterator[bytes]:
    """The records of an archive, one after the other."""
    import zstandard

    view, at, decompressor = memoryview(data), 0, zstandard.ZstdDecompressor()
    while at < len(view):
        magic, size = struct.unpack_from("<II", view, at)
        if magic >> 4 == DICTIONARY_MAGIC >> 4:
            if magic == DICTIONARY_MAGIC:
                content = bytes(view[at + 8 : at + 8 + size])
                trained = content[:4] == struct.pack("<I", 0xEC30A437)
                kind = zstandard.DICT_TYPE_FULLDICT if trained else zstandard.DICT_TYPE_RAWCONTENT
                decompressor = zstandard.ZstdDecompressor(
                    dict_data=zstandard.ZstdCompressionDict(content, dict_type=kind)
                )
            at += 8 + size
            continue
        if magic != FRAME_MAGIC:
            raise ValueError("not a Zstandard frame")
        stream, found = decompressor.decompressobj(), []
        while not stream.eof:
            if at >= len(view):
                raise ValueError("an archive ends inside a record")
            found.append(stream.decompress(view[at : at + READ_BYTES]))
            at = min(at + READ_BYTES, len(view))
        at -= len(stream.unused_data)
        yield b"".join(found)


def with_revisits(pages: DataFrame, id_col: str, payload_col: str, min_bytes: int = 0) -> DataFrame:
    """``pages`` (id and payload) with ``refers_to`` and ``revisit``.

    Of rows whose equal payloads have at least ``min_bytes`` bytes, those of the largest id are
    responses (nulls are smallest), the others revisit them.  The
    table is joined with one row per payload that occurs under two ids or more,
    which is written down and sent to every task where its measured size allows;
    else both sides are shuffled, and Spark's skew handling can split a common payload.
    """
    keyed = pages.withColumn("__sha1", F.sha1(F.col(payload_col)))
    firsts = (
        keyed.filter(F.octet_length(payload_col) >= min_bytes)
        .groupBy("__sha1")
        .agg(F.max(id_col).alias("__first"), F.min(id_col).alias("__least"), F.count(F.lit(1)).alias("__n"), F.count(id_col).alias("__ids"))
        .filter((F.col("__first") > F.col("__least")) | ((F.col("__ids") > 0) & (F.col("__ids") < F.col("__n"))))
        .select("__sha1", "__first")
    )
    joined = keyed.join(runtime.broadcast_if_small(runtime.checkpointed(firsts)), "__sha1", "left")
    revisit = F.col("__first").isNotNull() & ~F.col(id_col).eqNullSafe(F.col("__first"))
    return joined.select(
        *pages.columns, F.when(revisit, F.col("__first")).alias("refers_to"), revisit.alias("revisit")
    )


def write_archives(
    pages: DataFrame,
    path: str,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    min_bytes: int = 0,
    archive_bytes: int = ARCHIVE_BYTES,
) -> None:
    """One record per row of ``pages`` into archives under ``path``.

    The payload is ``payload_col`` in UTF-8, empty for null.  Null ids are
    written as the empty key; rows that repeat are repeated records; an empty
    table leaves a folder without records.  Other columns are not read.
    """
    rows = pages.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"),
        F.encode(F.coalesce(F.col(payload_col), F.lit("")), "UTF-8").alias("payload"),
    )
    total = rows.agg(F.sum(F.octet_length("payload") + F.lit(512))).first()[0] or 0
    archives = max(1, math.ceil(total / archive_bytes))
    marked = with_revisits(rows, "id", "payload", min_bytes)
    # A revisit carries no payload, only its digest; it still is read to be archived.
    dealt = marked.select(
        F.col("id").cast("string").alias("id"), "url", "payload", F.col("refers_to").cast("string").alias("refers_to"), "revisit"
    ).repartition(archives, F.xxhash64("id", "url", "payload"))
    out = arrow_schema("frame binary")

    def run(batches):
        def records():
            for batch in batches:
                for start in range(0, batch.num_rows, 64):
                    for row in batch.slice(start, 64).to_pylist():
                        yield record(row["id"] or "", row["url"], row["payload"], row["refers_to"], row["revisit"])

        held, size = [], 0
        for frame in frames(records()):
            held.append(frame)
            size += len(frame)
            if size >= 4 * 1024 * 1024:
                yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], schema=out)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], schema=out)

    (
        dealt.mapInArrow(run, "frame binary")
        .select(F.col("frame").cast("string").alias("value"))
        .write.option("lineSep", SEPARATOR)
        .option("compression", "none")
        .text(path)
    )


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives under ``path``: ``key, url, payload_bytes, payload_digest,
    record_type, refers_to, payload`` (null for revisits).

    Every response is checked against its digest; a broken archive fails the job.
    """
    schema = (
        "key string, url string, payload_bytes bigint, payload_digest string, record_type string, "
        "refers_to string, payload binary"
    )
    out = arrow_schema(schema)

    def rows(data):
        for found in read_archive(data):
            fields, block = parse_record(found)
            kind = fields["WARC-Type"]
            sha1 = fields["WARC-Payload-Digest"].removeprefix("sha1:")
            if kind == "response" and (digest(block) != sha1 or len(block) != int(fields["X-Payload-Length"])):
                raise ValueError(f"record {fields['WARC-Record-ID']} differs from its digest")
            refers = fields.get("X-Refers-To-Key")
            yield (
                base64.b64decode(fields["X-Record-Key"]).decode(),
                fields["WARC-Target-URI"],
                int(fields["X-Payload-Length"]),
                sha1,
                kind,
                None if refers is None else base64.b64decode(refers).decode(),
                block if kind == "response" else None,
            )

    def pack(held):
        return pa.RecordBatch.from_arrays(
            [pa.array(list(c), f.type) for c, f in zip(zip(*held), out)], schema=out
        )

    def run(batches):
        for batch in batches:
            for data in batch.column(0):
                held, size = [], 0
                for row in rows(data.as_buffer()):
                    held.append(row)
                    size += 256 + len(row[-1] or b"")
                    if size >= 4 * 1024 * 1024:
                        yield pack(held)
                        held, size = [], 0
                if held:
                    yield pack(held)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path).select("content")
    return files.mapInArrow(run, schema)
