"""Token counts through a whole-token shortcut.

SentencePiece BPE turns every space into U+2581 and merges neighbouring
symbols into pieces of its vocabulary.  No piece of the vocabulary holds
U+2581 after another character (``WholeTokens`` proves it when it loads the
model), so no merge crosses the start of a run of spaces: the tokens of a text
are the tokens of its pre-tokens, each a run of spaces with the characters up
to the next one.  Which vocabulary strings the model keeps whole is proved
once, by encoding each of them alone; a pre-token that is one of them counts
as one, and only the rest goes through the merges.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog_engine.llm.common import arrow_schema, default_tokenizer, slices

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
# Pre-tokens a worker remembers; beyond that it starts again from the whole tokens.
KNOWN_WORDS = 400_000
# Longer pre-tokens are counted without being remembered.
KNOWN_CHARS = 64


class WholeTokens:
    """Counts tokens of texts for one model file."""

    def __init__(self, model_path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        ids = [
            i
            for i in range(self.model.get_piece_size())
            if not (self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_byte(i))
        ]
        pieces = {self.model.id_to_piece(i): i for i in ids}
        #: Whether a text may be cut before every run of spaces.
        self.cuts = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in pieces)
        self.lone_space = 1 if SPACE in pieces else len(SPACE.encode())
        # As the encoder is asked: without the first space, which the model adds.
        starts = {p[1:].replace(SPACE, " "): i for p, i in pieces.items() if p.startswith(SPACE) and len(p) > 1}
        alone = self.model.encode(list(starts), num_threads=1)
        self.whole = {text: 1 for (text, i), got in zip(starts.items(), alone) if got == [i]}
        self.known = dict(self.whole)

    def pretokens(self, text: str) -> list[str]:
        """The pre-tokens of a text, each without its first space; their encodings concatenate to the text's."""
        text = text.replace(SPACE, " ")
        if "  " not in text and not text.startswith(" "):
            return text.split(" ")
        return [p[1:] for p in re.findall(" +[^ ]*", " " + text)]

    def counts(self, texts: list[str]) -> list[int]:
        if not self.cuts:
            return [len(ids) for ids in self.model.encode(texts, num_threads=1)]
        split = [self.pretokens(t) if t else [] for t in texts]
        known = self.known
        if len(known) > KNOWN_WORDS:
            known = self.known = dict(self.whole)
        known[""] = self.lone_space
        rest = list({w for words in split for w in words if w not in known})
        long = {}
        for part in slices(rest):
            for word, ids in zip(rest[part], self.model.encode(rest[part], num_threads=1)):
                (known if len(word) <= KNOWN_CHARS else long)[word] = len(ids)
        if long:
            return [sum(known[w] if w in known else long[w] for w in words) for words in split]
        return [sum(map(known.__getitem__, words)) for words in split]


def count_tokens(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_path: str | None = None, limit: int = 4096
) -> DataFrame:
    """One row per row of ``df``: the id, ``n_bytes``, ``n_tokens``, ``over_limit``.

    Counts are those of the sentencepiece library for the model at
    ``model_path`` (default: the installed public model), without begin and end
    tokens, over whole texts.  A null text counts as an empty one (0 bytes, 0
    tokens); null and repeated ids and repeated rows are kept, one row each; an
    empty table gives an empty one; other columns of ``df`` are not read.
    """
    id_type = df.schema[id_col].dataType.simpleString()
    out = arrow_schema(f"id {id_type}, n_bytes bigint, n_tokens bigint")

    def run(batches):
        model = WholeTokens(model_path or default_tokenizer(MODEL))
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for part in slices(texts):
                some = texts[part]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(part.start, len(some)),
                        pa.array([len(t.encode()) for t in some], pa.int64()),
                        pa.array(model.counts(some), pa.int64()),
                    ],
                    schema=out,
                )

    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    counted = rows.mapInArrow(run, f"id {id_type}, n_bytes bigint, n_tokens bigint")
    return counted.select(
        F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
