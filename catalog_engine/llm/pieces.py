"""SentencePiece encoding and decoding by an Aho-Corasick automaton and a Viterbi pass.

The automaton over all pieces reads a text once.  At each position its output
links name every piece that ends there, longest first, and each of them relaxes
the best score of that position: best[end] = max(best[end - length] + score).
That is the unigram segmentation of SentencePiece; a character that is no piece
costs the lowest score less ``UNKNOWN_PENALTY`` and falls back to its bytes.

As no piece holds a space mark after another character (checked when the
model is loaded), the best segmentation of a text is made of those of its
pre-tokens, and a worker remembers those it has met.  With any other model the
pass runs over whole texts.
"""

from __future__ import annotations

import re
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StringType, StructField, StructType

from catalog_engine.llm.common import SLICE_BYTES, arrow_schema, default_tokenizer, slices

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
#: What the library takes off the lowest score for an unknown character.
UNKNOWN_PENALTY = 10.0
KNOWN_WORDS = 250_000
KNOWN_CHARS = 64


class Pieces:
    """Vocabulary and automaton of one SentencePiece model file."""

    def __init__(self, model_path: str):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        size = model.get_piece_size()
        self.text = [model.id_to_piece(i) for i in range(size)]
        self.special = {i for i in range(size) if model.is_control(i) or model.is_unknown(i)}
        self.unknown = model.unk_id()
        self.byte_of = {i: int(self.text[i][3:5], 16) for i in range(size) if model.is_byte(i)}
        self.id_of_byte = {b: i for i, b in self.byte_of.items()}
        normal = [i for i in range(size) if i not in self.special and i not in self.byte_of]
        self.score = {i: model.get_score(i) for i in normal}
        self.unknown_score = min(self.score.values()) - UNKNOWN_PENALTY
        self.single = {self.text[i] for i in normal if len(self.text[i]) == 1}
        self.cuts = not any(re.search(f"[^{SPACE}]{SPACE}", self.text[i]) for i in normal)
        self.automaton = ahocorasick.Automaton()
        for i in normal:
            self.automaton.add_word(self.text[i], (i, len(self.text[i]), self.score[i]))
        self.automaton.make_automaton()
        self.known: dict[str, bytes] = {}

    def viterbi(self, marked: str) -> list[int]:
        """Ids of the best segmentation; among equal scores the longest last piece."""
        size = len(marked)
        best, last = [0.0] * (size + 1), [None] * (size + 1)
        done = 0 if not self.single.issuperset(marked) else size
        for end, (piece, length, score) in self.automaton.iter(marked):
            end += 1
            while done < end - 1:  # positions no piece ends at: only an unknown character leads there
                done += 1
                self._relax_unknown(marked, done, best, last)
            if done == end - 1:
                # The first match at this end; whether its last character alone is unknown is settled after the others.
                done = end if marked[end - 1] in self.single else done
            value = best[end - length] + score
            if last[end] is None or value > best[end]:
                best[end], last[end] = value, (piece, length)
        while done < size:
            done += 1
            self._relax_unknown(marked, done, best, last)
        ids = []
        while size:
            piece, length = last[size]
            if piece is None:
                ids.extend(reversed(self._bytes(marked[size - 1])))
            else:
                ids.append(piece)
            size -= length
        ids.reverse()
        return ids

    def _relax_unknown(self, marked, end, best, last):
        if marked[end - 1] in self.single:
            return
        value = best[end - 1] + self.unknown_score
        if last[end] is None or value > best[end]:
            best[end], last[end] = value, (None, 1)

    def _bytes(self, char: str) -> list[int]:
        if not self.id_of_byte:
            return [self.unknown]
        return [self.id_of_byte[b] for b in char.encode()]

    def words(self, text: str) -> list[str]:
        """The text as the model sees it, cut where no piece can lie across."""
        if not text:
            return []
        text = SPACE + text.replace(" ", SPACE)
        if not self.cuts:
            return [text]
        if SPACE * 2 not in text:
            return [SPACE + w for w in text[1:].split(SPACE)]
        return re.findall(f"{SPACE}+[^{SPACE}]*", text)

    def encode_packed(self, text: str) -> bytes:
        """The ids of a text as little-endian 32-bit numbers."""
        known, words = self.known, self.words(text)
        if len(known) > KNOWN_WORDS:
            known.clear()
        out = list(map(known.get, words))
        if None in out:
            for i, packed in enumerate(out):
                if packed is None:
                    word = words[i]
                    packed = known.get(word)
                    if packed is None:
                        ids = self.viterbi(word)
                        packed = struct.pack(f"<{len(ids)}i", *ids)
                        if len(word) <= KNOWN_CHARS:
                            known[word] = packed
                    out[i] = packed
        return b"".join(out)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_packed(text), "<i4").tolist()

    def decode(self, ids) -> str:
        """The text of ids: bytes joined as UTF-8, marks turned into spaces, the first one dropped."""
        out, held = [], bytearray()
        for i in ids:
            if i in self.byte_of:
                held.append(self.byte_of[i])
                continue
            if held:
                out.append(held.decode("utf-8", "replace"))
                held.clear()
            if i == self.unknown:
                out.append(" ⁇ ")
            elif 0 <= i < len(self.text) and i not in self.special:
                out.append(self.text[i])
        if held:
            out.append(held.decode("utf-8", "replace"))
        text = "".join(out).replace(SPACE, " ")
        return text[1:] if text.startswith(" ") else text


def _packed_lists(packed: list[bytes], kind: pa.DataType) -> pa.Array:
    ends = np.cumsum([0] + [len(p) // 4 for p in packed])
    values = pa.array(np.frombuffer(b"".join(packed), "<i4"), pa.int32())
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values).cast(kind)


def _fields(df: DataFrame, keep: tuple[str, ...]) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)


def encode(
    df: DataFrame, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text", model_path: str | None = None
) -> DataFrame:
    """One row per row of ``df``: the columns of ``keep``, ``n_tokens``, ``ids array<int>``, ``round_trip``.

    Whole texts, no begin or end tokens.  ``round_trip`` says whether decoding the ids
    gives the text back.  A null text is an empty one and has no tokens; null
    and repeated ids and repeated rows are kept; an empty table gives an empty
    one; columns outside ``keep`` are not read and may have any name.
    """
    schema, k = f"{_fields(df, keep)}, ids array<int>, round_trip boolean", len(keep)
    out = arrow_schema(schema)

    def run(batches):
        model = Pieces(model_path or default_tokenizer(MODEL))
        for batch in batches:
            texts = batch.column(k).to_pylist()
            for part in slices(texts, SLICE_BYTES // 2):
                packed = [model.encode_packed(t) for t in texts[part]]
                same = [
                    model.decode(np.frombuffer(p, "<i4").tolist()) == t.replace(SPACE, " ")
                    for p, t in zip(packed, texts[part])
                ]
                some = batch.slice(part.start, len(packed))
                yield pa.RecordBatch.from_arrays(
                    [*some.columns[:k], _packed_lists(packed, out.field(k).type), pa.array(same)], schema=out
                )

    rows = df.select(*keep, F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    return rows.mapInArrow(run, schema).select(*keep, F.size("ids").cast("long").alias("n_tokens"), "ids", "round_trip")


def decode(df: DataFrame, ids_col: str = "ids", out_col: str = "decoded", model_path: str | None = None) -> DataFrame:
    """``df`` with ``out_col``, the text of ``ids_col`` (null for null); a column of that name is replaced.

    Decoding an encoded text gives the text back, but for a literal U+2581,
    which the model cannot tell from a space.
    """
    names = [c for c in df.columns if c != out_col]
    rest = df.select(*names)
    schema = StructType([*rest.schema.fields, StructField(out_col, StringType())])
    out = to_arrow_schema(schema)
    at = names.index(ids_col)

    def run(batches):
        model = Pieces(model_path or default_tokenizer(MODEL))
        for batch in batches:
            step = max(1, int(batch.num_rows * SLICE_BYTES / max(1, batch.column(at).nbytes)))
            for start in range(0, batch.num_rows, step):
                some = batch.slice(start, step)
                texts = [None if ids is None else model.decode(ids) for ids in some.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(texts, pa.string())], schema=out)

    return rest.mapInArrow(run, schema)
