"""Tiered fuzzy name score.

Exact, whole-word, prefix and substring hits are built-in expressions.  Only
names no tier placed go to an Arrow function, which computes the three edit
ratios for a whole batch at a time.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from catalog_engine.functions import text

# Scores per tier, the cap and the blend weights.
EXACT, WORD_HIT, PREFIX, SUBSTRING, CAP = 100.0, 95.0, 90.0, 85.0, 80.0
RATIO_WEIGHT, TOKEN_SET_WEIGHT, TOKEN_SORT_WEIGHT = 0.4, 0.4, 0.2

DECIMALS = 9
_CELLS = 1 << 21  # characters held in one padded block


class _Padded:
    """Texts as blocks of padded characters, ready to be compared with many patterns."""

    def __init__(self, texts: Sequence[str]):
        self.size = len(texts)
        self.blocks = []
        # Similar lengths go together, so that one long text pads few others.
        order = sorted(range(len(texts)), key=lambda i: len(texts[i]))
        start = 0
        for end in range(1, len(order) + 1):
            last = end == len(order)
            if last or (end + 1 - start) * len(texts[order[end]]) > _CELLS:
                rows = order[start:end]
                block = np.array([texts[i] for i in rows])
                chars = block.view(np.uint32).reshape(len(rows), block.dtype.itemsize // 4)
                self.blocks.append((np.array(rows), chars))
                start = end

    def lcs(self, pattern: str, among: np.ndarray | None = None) -> np.ndarray:
        """Length of the longest common subsequence of each text with ``pattern``.

        Bit-parallel: the pattern lies across 64-bit words, and one step per
        character position updates all texts of a block together.
        """
        out = np.zeros(self.size, dtype=np.int64)
        if not pattern:
            return out
        codes = np.array([ord(ch) for ch in pattern], dtype=np.uint32)
        alphabet, where = np.unique(codes, return_inverse=True)
        words = -(-len(codes) // 64)
        masks = np.zeros((words, len(alphabet) + 1), dtype=np.uint64)  # last column: no match
        for i, a in enumerate(where):
            masks[i // 64, a] |= np.uint64(1 << (i % 64))
        used = [np.uint64((1 << min(64, len(codes) - 64 * w)) - 1) for w in range(words)]

        for rows, chars in self.blocks:
            if among is not None:
                picked = among[rows]
                rows, chars = rows[picked], chars[picked]
            if not len(rows):
                continue
            chars = chars.T  # one row per character position
            at = np.minimum(np.searchsorted(alphabet, chars), len(alphabet) - 1)
            at = np.where((alphabet[at] == chars) & (chars != 0), at, len(alphabet))
            state = np.full((words, len(rows)), np.uint64(0xFFFFFFFFFFFFFFFF))
            for here in at:
                carry = np.zeros(len(rows), dtype=np.uint64)
                for w in range(words):
                    mask = masks[w, here]
                    low = state[w] + (state[w] & mask)
                    total = low + carry
                    if words > 1:
                        carry = ((low < state[w]) | (total < low)).astype(np.uint64)
                    state[w] = total | (state[w] & ~mask)
            for w in range(words):
                out[rows] += np.bitwise_count(~state[w] & used[w])
        return out


def lcs_lengths(texts: Sequence[str], pattern: str) -> np.ndarray:
    return _Padded(texts).lcs(pattern)


def _ratio(common: np.ndarray, la: np.ndarray, lb: np.ndarray | int) -> np.ndarray:
    total = np.asarray(la + lb, dtype=np.float64)
    return np.where(total == 0, 100.0, 200.0 * common / np.where(total == 0, 1.0, total))


def _lengths(texts: Sequence[str]) -> np.ndarray:
    return np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))


def _classes(s: str) -> np.ndarray:
    return (np.frombuffer(s.encode("utf-32-le"), dtype=np.uint32) % NameBlock.CLASSES).astype(np.int64)


class NameBlock:
    """Distinct normalised names, prepared once and scored against many terms."""

    CLASSES = 64  # characters are counted in this many classes

    def __init__(self, names: Sequence[str]):
        self.names = names
        self.strings = pa.array(names, type=pa.string())
        self.lengths = _lengths(names)
        self.words = [n.split() for n in names]
        self.no_twice = np.ones(len(names), dtype=bool)  # no word occurs twice
        self.rows_with: dict[str, list[int]] = {}
        for i, ws in enumerate(self.words):
            distinct = set(ws)
            self.no_twice[i] = len(distinct) == len(ws)
            for w in distinct:
                self.rows_with.setdefault(w, []).append(i)
        single = np.array([" ".join(ws) == n for n, ws in zip(names, self.words)], dtype=bool)
        self.plain = self.no_twice & single  # and single spaces only
        row = np.repeat(np.arange(len(names)), self.lengths)
        counts = np.bincount(row * self.CLASSES + _classes("".join(names)), minlength=len(names) * self.CLASSES)
        self.counts = counts.reshape(len(names), self.CLASSES)

    # Needed only once a name survives the pruning.

    @cached_property
    def sorted(self) -> list[str]:
        return [" ".join(sorted(ws)) for ws in self.words]

    @cached_property
    def sorted_lengths(self) -> np.ndarray:
        return _lengths(self.sorted)

    @cached_property
    def in_order(self) -> np.ndarray:
        return np.array([n == s for n, s in zip(self.names, self.sorted)], dtype=bool)

    @cached_property
    def chars(self) -> _Padded:
        return _Padded(self.names)

    @cached_property
    def sorted_chars(self) -> _Padded:
        return _Padded(self.sorted)

    def _sharing(self, words: Sequence[str]) -> np.ndarray:
        """Names that have one of the words."""
        out = np.zeros(len(self.names), dtype=bool)
        for w in words:
            out[self.rows_with.get(w, [])] = True
        return out

    def may_pass(self, term: str, floor: float) -> np.ndarray:
        """False only where the blend cannot exceed ``floor``.

        No subsequence is longer than the characters both texts have, class by
        class.  While no word is shared, that bounds all three ratios alike.
        """
        words = term.split()
        if " ".join(words) != term or len(set(words)) != len(words):
            return np.ones(len(self.names), dtype=bool)
        wanted = np.bincount(_classes(term), minlength=self.CLASSES)
        used = np.flatnonzero(wanted)
        common = np.minimum(self.counts[:, used], wanted[used]).sum(axis=1)
        near = _ratio(common, self.lengths, len(term)) > floor - 1e-6
        return near | ~self.plain | self._sharing(words)

    def blend(self, term: str, floor: float = 0.0, among: np.ndarray | None = None) -> np.ndarray:
        """Weighted edit ratios, capped below every real hit; 0 where they cannot exceed ``floor``."""
        todo = np.ones(len(self.names), dtype=bool) if among is None else among
        if floor > 0:
            todo = todo & self.may_pass(term, floor)
        rows = np.flatnonzero(todo)
        if 2 * len(rows) < len(self.names):
            out = np.zeros(len(self.names))
            if len(rows):
                out[rows] = NameBlock([self.names[i] for i in rows]).blend(term)
            return out
        words = sorted(term.split())
        by_word = " ".join(words)

        ratio = _ratio(self.chars.lcs(term, todo), self.lengths, len(term))
        # Texts whose words are in order already give the same ratio again.
        same = self.in_order if by_word == term else np.zeros_like(self.in_order)
        token_sort = np.where(
            same, ratio, _ratio(self.sorted_chars.lcs(by_word, todo & ~same), self.sorted_lengths, len(by_word))
        )
        # So do word sets, while no word is shared or doubled.
        apart = ~self._sharing(words) & (self.sorted_lengths > 0) & self.no_twice
        if len(set(words)) != len(words) or not words:
            apart[:] = False
        token_set = token_sort.copy()
        rest = np.flatnonzero(todo & ~apart)
        token_set[rest] = token_set_ratio([self.words[i] for i in rest], words)

        blend = RATIO_WEIGHT * ratio + TOKEN_SET_WEIGHT * token_set + TOKEN_SORT_WEIGHT * token_sort
        # Rounded, so that scores which are equal on paper tie.
        return np.where(todo, np.minimum(np.round(blend, DECIMALS), CAP), 0.0)

    def scores(self, term: str, floor: float = 0.0) -> np.ndarray:
        """All tiers per name; 0 where the score cannot exceed ``floor``."""
        held = pc.match_substring(self.strings, term).to_numpy(zero_copy_only=False)
        out = self.blend(term, floor, ~held)
        word = re.compile(rf"(?<!\w){re.escape(term)}(?!\w)") if re.fullmatch(r"\w+", term) else None
        for i in np.flatnonzero(held):
            n = self.names[i]
            out[i] = (
                EXACT if n == term
                else WORD_HIT if word is not None and word.search(n)
                else PREFIX if n.startswith(term)
                else SUBSTRING
            )
        return out


def token_set_ratio(names: Sequence[Sequence[str]], term: Sequence[str]) -> np.ndarray:
    """Best ratio among the shared words and both sides' own words (word lists)."""
    want = set(term)
    out = np.zeros(len(names))
    rest: dict[str, list[tuple[int, int, str]]] = {}  # the term's own words -> names
    for i, words in enumerate(names):
        have = set(words)
        if not have or not want:
            continue
        shared = have & want
        if shared and (have <= want or want <= have):
            out[i] = 100.0
            continue
        rest.setdefault(" ".join(sorted(want - have)), []).append(
            (i, len(" ".join(shared)), " ".join(sorted(have - want)))
        )
    for missing, group in rest.items():
        at = np.array([g[0] for g in group])
        base = np.array([g[1] for g in group])
        extra = [g[2] for g in group]
        glue = base + (base > 0)  # the shared words and one space lead both sides
        left, right = glue + _lengths(extra), glue + len(missing)
        best = _ratio(glue + lcs_lengths(extra, missing), left, right)
        shared_only = np.maximum(_ratio(base, base, left), _ratio(base, base, right))
        out[at] = np.where(base > 0, np.maximum(best, shared_only), best)
    return out


def blended_ratio(names: Sequence[str], term: str) -> np.ndarray:
    return NameBlock(names).blend(term)


def tier_score(norm: Column, term: str) -> Column:
    """Tiers 1-4 for a normalised name column; NULL when none applies."""
    tiers = F.when(norm == term, EXACT)
    if re.fullmatch(r"\w+", term):  # a term with a space is never one word
        w = text.WORD
        tiers = tiers.when(norm.rlike(rf"(?<!{w}){text.java_quote(term)}(?!{w})"), WORD_HIT)
    return F.when(norm.contains(term), tiers.when(norm.startswith(term), PREFIX).otherwise(SUBSTRING))


def _blend_udf(term: str, floor: float):
    @F.arrow_udf("double")
    def blend(names: pa.Array) -> pa.Array:
        coded = names.dictionary_encode()
        scores = NameBlock(coded.dictionary.to_pylist()).blend(term, floor)
        return pa.array(scores, type=pa.float64()).take(coded.indices)

    # Evaluated once even when a filter looks at the score.
    return blend.asNondeterministic()


def normalized_score(norm: Column, term: str, floor: float = 0.0) -> Column:
    """Score 0-100 of a normalised name against a normalised term; NULL scores 0.

    Scores that cannot exceed ``floor`` may be given as 0.
    """
    tier = tier_score(norm, term)
    leftover = F.when(tier.isNull(), norm)
    return F.coalesce(tier, _blend_udf(term, floor)(leftover), F.lit(0.0))


def fuzzy_score(name: Column | str, term: str, aliases: Sequence[tuple[str, str]] = ()) -> Column:
    """Score 0-100 of a name against one search term; a NULL name scores 0."""
    return normalized_score(text.normalize_aliases(name, aliases), text.normalize_term(term, aliases))
