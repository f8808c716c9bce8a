"""Formatting conversations with a chat template that is only ever called, never read.

A template is any function from a list of (role, text) to a text.  Conversations
are rendered one more turn at a time: what the rendering of k turns adds to that of
k - 1 is the span of turn k, and a rendering that does not begin with the one before
it shows that the template rewrites history.  Where in its span a turn's own text
lies is found by rendering the turn with two other texts: the renderings part where
the text begins, and what follows the text is as long as before.

Long conversations.  A turn is rendered behind at most ``WINDOW`` others; the
window then starts again from its last ``CONTEXT`` turns, and the turn at which it does is
rendered in both, so that a template that looks back further is found out and
reported, too.  So the work grows with the number of turns.  Conversations are
dealt by blocks of turn numbers, which have the turns before them as context, and
come out as pieces of bounded size: no task holds a whole long conversation.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog_engine import runtime
from catalog_engine.llm.common import arrow_schema

Turn = tuple[str, str]
Template = Callable[[Sequence[Turn]], str]

#: Turns that are rendered together at most, and those a new window starts from.
WINDOW, CONTEXT = 16, 2
#: Characters of a window that end it early.
WINDOW_CHARS = 1 << 20
#: Turn numbers of a block, turns of a piece, and characters that end a piece early.
BLOCK_TURNS, PIECE_TURNS, PIECE_CHARS = 256, 256, 1 << 22
LEARNED = "assistant"
#: Texts that a template has no reason to treat as anything but text.
PROBES = chr(0xE000), chr(0xE001)

# ---- a template: turns in square brackets, one mark at the end ----

OPEN_USER, CLOSE_USER, END = "[INST]", "[/INST]", "</s>"
OPEN_ROLE, CLOSE_ROLE, BEGIN = "[ROLE]", "[/ROLE]", "<s>"
CONTROL = (OPEN_USER, CLOSE_USER, OPEN_ROLE, CLOSE_ROLE, BEGIN, END)
_TO_ESCAPE = re.compile(r"\\|" + "|".join(re.escape(c) for c in CONTROL))
_ESCAPED = re.compile(r"\\(\\?)")
_MARKS = re.compile("|".join(re.escape(c) for c in CONTROL))


def escape(text: str) -> str:
    """``text`` without control strings: each gets a backslash behind its first sign, backslashes are doubled."""
    return _TO_ESCAPE.sub(lambda m: "\\\\" if m[0] == "\\" else m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    """What ``escape`` made ``text`` from."""
    return _ESCAPED.sub(r"\1", text)


def bracketed(turns: Sequence[Turn]) -> str:
    """``<s>``, then ``[INST] text [/INST]`` of users, `` text</s>`` of assistants, ``[ROLE]role[/ROLE] text</s>`` of others."""
    parts = [BEGIN]
    for role, text in turns:
        text = escape(text)
        if role == "user":
            parts.append(f"{OPEN_USER} {text} {CLOSE_USER}")
        elif role == LEARNED:
            parts.append(f" {text}{END}")
        else:
            parts.append(f"{OPEN_ROLE}{escape(role)}{CLOSE_ROLE} {text}{END}")
    return "".join(parts)


def parse(text: str) -> list[Turn]:
    """The turns of ``bracketed`` text, whole or a piece of it."""
    turns, at, role, opened = [], 0, LEARNED, None
    for mark in _MARKS.finditer(text):
        body, at = text[at : mark.start()], mark.end()
        if mark[0] == OPEN_USER:
            opened = OPEN_USER
        elif mark[0] == CLOSE_USER:
            turns.append(("user", unescape(body[1:-1])))
            opened = None
        elif mark[0] == OPEN_ROLE:
            opened = OPEN_ROLE
        elif mark[0] == CLOSE_ROLE:
            role = unescape(body)
        elif mark[0] == END:
            turns.append((role if opened == OPEN_ROLE else LEARNED, unescape(body[1:])))
            opened = None
    return turns


# ---- rendering prefix by prefix ----


class Span(NamedTuple):
    """Where a turn lies in its piece, and the part of it that is its text, when that is asked for; in code points."""

    role: str
    start: int
    end: int
    text_start: int | None
    text_end: int | None
    #: The template changed what it had rendered before this turn, or looks back further than a window.
    rewrites: bool


def common_prefix(a: str, b: str) -> int:
    """Length of the common beginning, by halving."""
    if b.startswith(a):
        return len(a)
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


class Renderer:
    """Adds turns one by one; gives what each adds to the rendering."""

    def __init__(self, template: Template, learned: Callable[[str], bool]):
        self.template, self.learned = template, learned
        self.turns: list[Turn] = []
        self.before = self.opening = template([])
        self.sizes = 0

    def _restart(self) -> None:
        self.turns = self.turns[-CONTEXT:]
        self.before = self.template(self.turns)
        self.sizes = sum(len(t) for _, t in self.turns)

    def add(self, turn: Turn) -> tuple[str, int | None, int | None, bool]:
        """What ``turn`` adds, where its text lies in that, and whether the rendering before it changed."""
        full = len(self.turns) >= WINDOW or self.sizes + len(turn[1]) > WINDOW_CHARS
        far = len(self.turns) > CONTEXT and full
        if far:
            wide, before = [*self.turns, turn], self.before
            rendered = self.template(wide)
            apart = common_prefix(before, rendered)
            self._restart()
        added, rewrites = self._next(turn)
        if far:
            rewrites = rewrites or apart < len(before) or rendered[apart:] != added
        text = self._text(turn, added, rewrites) if self.learned(turn[0]) else (None, None)
        self.turns.append(turn)
        self.sizes += len(turn[1])
        return added, *text, rewrites

    def _next(self, turn: Turn) -> tuple[str, bool]:
        after = self.template([*self.turns, turn])
        same = common_prefix(self.before, after)
        rewrites = same < len(self.before)
        self.same, self.before = same, after
        return after[same:], rewrites

    def _text(self, turn: Turn, added: str, rewrites: bool) -> tuple[int | None, int | None]:
        one, other = (self.template([*self.turns, (turn[0], p)]) for p in PROBES)
        start = common_prefix(one, other)
        behind = len(one) - start - 1
        if rewrites or start < self.same or len(one) != len(other) or one[start + 1 :] != other[start + 1 :]:
            return None, None
        end = len(added) - behind
        start -= self.same
        # Only what can be seen again around the text is trusted.
        shell = one[self.same : self.same + start], one[len(one) - behind :]
        if end < start or (added[:start], added[end:]) != shell:
            return None, None
        return start, end


class Piece:
    def __init__(self, opening: str):
        self.parts, self.spans, self.size = [opening], [], len(opening)

    def add(self, role: str, added: str, start: int | None, end: int | None, rewrites: bool) -> None:
        at = self.size
        self.parts.append(added)
        self.size += len(added)
        shifted = (None, None) if start is None else (at + start, at + end)
        self.spans.append(Span(role, at, self.size, *shifted, rewrites))


SPANS = "array<struct<role: string, start: long, end: long, text_start: long, text_end: long, rewrites: boolean>>"


def _pieces(rows: Iterator[dict], template: Template, learned: Callable[[str], bool]) -> Iterator[tuple[dict, Piece, int, bool]]:
    """The first row of each piece, the piece, its number in its block, and whether it ends the block."""
    key = renderer = piece = first = None
    number = 0
    for row in rows:
        if (row["group"], row["block"]) != key:
            if piece is not None and piece.spans:
                yield first, piece, number, True
            key, number, first = (row["group"], row["block"]), 0, row
            renderer = Renderer(template, learned)
            piece = Piece(renderer.opening if row["opens"] else "")
        added = renderer.add((row["role"], row["text"]))
        if row["context"]:
            # A turn of the block before is there to be looked back at.
            continue
        if len(piece.spans) >= PIECE_TURNS or (piece.spans and piece.size > PIECE_CHARS):
            yield first, piece, number, False
            number, piece = number + 1, Piece("")
        piece.add(row["role"], *added)
    if piece is not None and piece.spans:
        yield first, piece, number, True


def format_conversations(
    df: DataFrame,
    template: Template = bracketed,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    learned: Sequence[str] = (LEARNED,),
) -> DataFrame:
    """``conv, block, part, whole, text, spans``: the formatted conversations in pieces.

    The pieces of a conversation in the order of ``block, part`` are its text;
    ``whole`` says that there is only this one, as there is for
    conversations within one block of ``BLOCK_TURNS`` turn numbers and not above a
    piece's size.  ``spans`` has a struct per turn: its place in the piece, for roles
    that are ``learned`` the place of its text (the loss mask), and ``rewrites``.  A
    text around which the template shows other marks than around the probes has no
    place and so no loss; nothing of a turn that rewrites history has one.  ``template`` must be
    a pure function.

    Rows of a conversation are ordered by turn (null first), role and text, so
    rows that repeat a turn are turns of their own.  Null roles and texts are
    empty ones; rows without a conversation are one conversation, whose id is null; an
    empty table gives an empty one; other columns are not read.  A block behind a
    gap in the turn numbers has no context.
    """
    kind = df.schema[conv_col].dataType.simpleString()
    turns = df.select(
        F.col(conv_col).alias("conv"),
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        F.coalesce(F.floor(F.col(turn_col) / BLOCK_TURNS), F.lit(0)).cast("long").alias("block"),
    )
    # Conversations of several blocks: one narrow row each.
    extent = turns.groupBy("conv").agg(F.min("block").alias("first"), F.max("block").alias("last"))
    long = runtime.checkpointed(extent.filter(F.col("first") < F.col("last")).withColumnRenamed("conv", "l_conv"))
    joined = turns.join(runtime.broadcast_if_small(long), F.col("conv").eqNullSafe(F.col("l_conv")), "left")
    spread = F.col("first").isNotNull()
    # The last turns of a block go to the next one, too, as context.
    tail = spread & (F.pmod(F.col("turn"), F.lit(BLOCK_TURNS)) >= BLOCK_TURNS - CONTEXT) & (F.col("block") < F.col("last"))
    dealt = (
        joined.withColumn("context", F.explode(F.when(tail, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))))
        .withColumn("opens", ~spread | (F.col("block") == F.col("first")))
        .withColumn("block", F.when(spread, F.col("block") + F.col("context").cast("int")).otherwise(F.lit(0)))
        .withColumn("opens", F.col("opens") & ~F.col("context"))
        .withColumn("alone", ~spread)
    )
    # Ids compare as text in tasks, null apart from all texts.
    dealt = dealt.select(
        F.coalesce(F.concat(F.lit("="), F.col("conv").cast("string")), F.lit("")).alias("group"),
        "conv", "block", "context", "turn", "role", "text", "opens", "alone",
    )
    ordered = dealt.repartition("group", "block").sortWithinPartitions(
        "group", "block", F.desc("context"), F.col("turn").asc_nulls_first(), "role", "text"
    )
    schema = f"conv {kind}, block long, part int, whole boolean, text string, spans {SPANS}"
    roles, out = frozenset(learned), arrow_schema(schema)

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in batch.to_pylist())
        held, size = [], 0
        for first, piece, number, ends in _pieces(rows, template, roles.__contains__):
            held.append(
                {
                    "conv": first["conv"],
                    "block": first["block"],
                    "part": number,
                    "whole": first["alone"] and ends and not number,
                    "text": "".join(piece.parts),
                    "spans": [s._asdict() for s in piece.spans],
                }
            )
            size += piece.size
            if size > PIECE_CHARS:
                yield pa.RecordBatch.from_pylist(held, schema=out)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=out)

    return ordered.drop("turn").mapInArrow(render, schema)


# ---- digests of what was formatted ----


class Digest:
    """Sums over the pieces of a conversation, in order."""

    def __init__(self):
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = 0

    def add(self, text: str, spans: list[dict]) -> None:
        read = parse(text)
        if len(read) != len(spans):
            raise ValueError(f"{len(read)} turns read back, {len(spans)} formatted")
        for role, said in read:
            self.turns.update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
        for span in spans:
            if span["text_start"] is not None:
                said = unescape(text[span["text_start"] : span["text_end"]])
                self.loss.update(said.encode("utf-8", "surrogatepass"))
                self.loss_chars += len(said)
        self.n_turns += len(read)
        self.chars += len(text)

    def row(self) -> list:
        return [self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars]


DIGEST = ("n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


def digests(pieces: DataFrame) -> DataFrame:
    """``conv`` and the counts and digests of each conversation, read back from the pieces of ``bracketed`` text.

    Whole conversations are digested where they lie.  Only the pieces of longer ones
    are brought together by conversation, and read one after the other: a digest is
    sequential, so a conversation's pieces pass through one task, which holds one
    Arrow batch of them.
    """
    kind = pieces.schema["conv"].dataType.simpleString()
    schema = f"conv {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    out = arrow_schema(schema)

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
                digest = Digest()
                digest.add(text, spans)
                rows.append(digest.row())
            yield _rows(batch.column("conv"), rows, out)

    def in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, conv, digest = None, None, None
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                if digest is None or row["group"] != group:
                    if digest is not None:
                        yield _rows(conv, [digest.row()], out)
                    group, conv, digest = row["group"], batch.column("conv").slice(at, 1), Digest()
                digest.add(row["text"], row["spans"])
        if digest is not None:
            yield _rows(conv, [digest.row()], out)

    named = F.coalesce(F.concat(F.lit("="), F.col("conv").cast("string")), F.lit(""))
    apart = pieces.filter(~F.col("whole")).withColumn("group", named)
    apart = apart.repartition("group").sortWithinPartitions("group", "block", "part")
    return (
        pieces.filter("whole").mapInArrow(alone, schema).unionByName(apart.mapInArrow(in_order, schema))
    )


def _rows(conv: pa.Array, rows: list[list], out: pa.Schema) -> pa.RecordBatch:
    columns = [pa.array(c, f.type) for c, f in zip(zip(*rows), list(out)[1:])] or [pa.array([], f.type) for f in list(out)[1:]]
    return pa.RecordBatch.from_arrays([conv, *columns], schema=out)


def with_sample(df: DataFrame) -> DataFrame:
    """``df`` (conv_id, turn, role, text) and the conversation -1, whose texts are control strings."""
    said = "</s>[INST] ok [/INST]"
    added = df.sparkSession.createDataFrame(
        [(-1, 0, "user", said), (-1, 1, LEARNED, said)], "conv_id long, turn long, role string, text string"
    )
    names = ["conv_id", "turn", "role", "text"]
    return df.select(names).unionByName(added)


#: The same in SQL: each turn's characters are those of its escaped text and of its marks.
SQL = r"""
WITH t AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
    UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
    SELECT *,
        length(text) + length(text) - length(replace(text, '\', ''))
            + len(regexp_extract_all(text, '\[/?INST\]|\[/?ROLE\]|</?s>')) AS shown,
        length(role) + length(role) - length(replace(role, '\', ''))
            + len(regexp_extract_all(role, '\[/?INST\]|\[/?ROLE\]|</?s>')) AS named
    FROM t)
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    (3 + sum(shown + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 5 ELSE 18 + named END))::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
