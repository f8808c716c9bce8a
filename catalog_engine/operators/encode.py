"""Text to vector.

An encoder is a factory: calling it once per task builds the model, and the
model turns a list of texts into a matrix.  A sentence model fits in as
``lambda: SentenceTransformer(name).encode``.

The built-in encoder hashes words into buckets.  It is a lexical stand-in, not
a language model: texts are near each other only as far as they share words.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Model = Callable[[Sequence[str]], np.ndarray]


class HashingEncoder:
    """Signed feature hashing of the words (split at white space), with unit-length rows.

    A word's md5 gives its bucket (first 8 hex digits) and its sign (the 9th),
    so that any engine with md5 can compute the same vectors.
    """

    CHARS = 1 << 20  # characters split into words at a time
    KNOWN = 1 << 20  # words whose hash is kept

    def __init__(self, dims: int = 384):
        self.dims = dims
        self.spots = _Spots(dims)

    def __call__(self) -> Model:
        return HashingEncoder(self.dims).encode

    def encode(self, texts: Sequence[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dims))
        start, chars = 0, 0
        for end, t in enumerate(texts, 1):
            chars += len(t)
            if chars >= self.CHARS or end == len(texts):
                out[start:end] = self._sums(texts[start:end])
                start, chars = end, 0
        length = np.sqrt((out * out).sum(axis=1, keepdims=True))
        return out / np.where(length == 0, 1.0, length)

    def _sums(self, texts: Sequence[str]) -> np.ndarray:
        if len(self.spots) > self.KNOWN:
            self.spots.clear()
        counts = [Counter(t.lower().split()) for t in texts]
        sizes = [len(c) for c in counts]
        spots = np.fromiter(map(self.spots.__getitem__, chain.from_iterable(counts)), np.int64, sum(sizes))
        times = np.fromiter(chain.from_iterable(c.values() for c in counts), np.int64, sum(sizes))
        cell = np.repeat(np.arange(len(texts)) * self.dims, sizes) + (spots >> 1)
        signed = np.where(spots & 1, -times, times)
        shape = (len(texts), self.dims)
        return np.bincount(cell, weights=signed, minlength=shape[0] * shape[1]).reshape(shape)


class _Spots(dict):
    """Word -> 2 x bucket, plus 1 for a negative sign; hashed on first sight."""

    def __init__(self, dims: int):
        self.dims = dims

    def __missing__(self, word: str) -> int:
        digest = hashlib.md5(word.encode()).hexdigest()
        self[word] = spot = int(digest[:8], 16) % self.dims * 2 + (digest[8] >= "8")
        return spot


def encoded(text_col: Column | str, encoder: Callable[[], Model]) -> Column:
    """Vector column ``array<float>`` for a text column; NULL text gives NULL."""

    @F.arrow_udf("array<float>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = encoder()
        for texts in batches:
            present = texts.drop_null()
            matrix = np.ascontiguousarray(model(present.to_pylist()), dtype=np.float32)
            width = matrix.shape[1] if len(present) else 0
            sizes = np.where(texts.is_valid().to_numpy(zero_copy_only=False), width, 0)
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            yield pa.ListArray.from_arrays(
                pa.array(offsets), pa.array(matrix.reshape(-1)), mask=texts.is_null()
            )

    return run(F.col(text_col) if isinstance(text_col, str) else text_col)


def encode(df: DataFrame, text_col: str, encoder: Callable[[], Model], out: str = "embedding") -> DataFrame:
    return df.withColumn(out, encoded(text_col, encoder))
