"""Many terms against many names by inverted lists.

A block of terms has lists of its words and of its numbered characters: the
second ``a`` of a term is another entry than the first.  A name meets the
lists once, for all terms: the product of the two tables of numbered characters
is the exact number of characters that each name and term share, and that number
and the two lengths bound every edit ratio.  A pair goes on when the bound passes,
when it shares a word, or when the term may lie inside the name; all
others can't pass.  What goes on is scored pair by pair, for all terms together.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np

from catalog_engine.functions import fuzzy
from catalog_engine.functions.fuzzy import NameBlock

#: Pairs of names and terms whose counts are held at once, and characters of pairs.
PAIRS, CELLS = 1 << 22, 1 << 21
WORD_BITS = 64


def _class_counts(texts: Sequence[str]) -> np.ndarray:
    row = np.repeat(np.arange(len(texts)), fuzzy._lengths(texts))
    at = row * NameBlock.CLASSES + fuzzy._classes("".join(texts))
    return np.bincount(at, minlength=len(texts) * NameBlock.CLASSES).reshape(len(texts), NameBlock.CLASSES)


class TermIndex:
    """Inverted lists of a block of normalised terms."""

    def __init__(self, terms: Sequence[str]):
        self.terms = list(terms)
        self.lengths = fuzzy._lengths(terms)
        self.words = [t.split() for t in terms]
        self.sorted = [" ".join(sorted(w)) for w in self.words]
        #: Words once each and single spaces only, for which the count bounds all ratios alike.
        self.plain = np.array([" ".join(w) == t and len(set(w)) == len(w) for t, w in zip(terms, self.words)], dtype=bool)
        self.in_order = np.array([s == t for s, t in zip(self.sorted, terms)], dtype=bool)
        self.sorted_lengths = fuzzy._lengths(self.sorted)
        self.sets = [set(w) for w in self.words]
        #: Some words, none of them twice.
        self.single = np.array([len(s) == len(w) and bool(w) for s, w in zip(self.sets, self.words)], dtype=bool)
        self.patterns: dict[int, re.Pattern | None] = {}
        listed: dict[str, list[int]] = {}
        for i, ws in enumerate(self.sets):
            for w in ws:
                listed.setdefault(w, []).append(i)
        self.terms_with = {w: np.array(at) for w, at in listed.items()}
        counts = _class_counts(terms)
        most = counts.max(axis=0, initial=0)
        #: The numbered characters that some term has: class and number.
        self.entries = [(c, k) for c in np.flatnonzero(most) for k in range(1, most[c] + 1)]
        self.table = self._numbered(counts).T.copy()

    def _numbered(self, counts: np.ndarray) -> np.ndarray:
        if not self.entries:
            return np.zeros((len(counts), 0), np.float32)
        classes, numbers = np.array(self.entries).T
        return (counts[:, classes] >= numbers).astype(np.float32)

    def candidates(self, names: NameBlock, floor: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Names and terms of the pairs that may score above ``floor``, and whether all of a term's characters are shared.

        A number of terms at a time, so that what is held doesn't grow with them.
        """
        numbered = self._numbered(names.counts)
        step = max(1, PAIRS // max(1, len(names.names)))
        for start in range(0, len(self.terms), step):
            some = slice(start, start + step)
            common = np.rint(numbered @ self.table[:, some]).astype(np.int32)
            lengths = self.lengths[some]
            inside = common == lengths
            keep = fuzzy._ratio(common, names.lengths[:, None], lengths[None, :]) > floor - 1e-6
            keep |= inside | ~names.plain[:, None] | ~self.plain[None, some]
            for word in {w for ws in self.words[some] for w in ws}:
                rows = names.rows_with.get(word)
                if rows:
                    terms = self.terms_with[word]
                    keep[np.ix_(rows, terms[(terms >= start) & (terms < start + step)] - start)] = True
            n, t = np.nonzero(keep)
            if len(n):
                yield n, t + start, inside[n, t]

    def scores(self, names: NameBlock, floor: float = 0.0) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Names, terms and scores of the pairs that score above ``floor``; equal to ``NameBlock.scores``."""
        for n, t, inside in self.candidates(names, floor):
            held = inside.copy()
            held[inside] = [self.terms[j] in names.names[i] for i, j in zip(n[inside].tolist(), t[inside].tolist())]
            score = np.zeros(len(n))
            for at in np.flatnonzero(held).tolist():
                score[at] = self._tier(names.names[n[at]], int(t[at]))
            if floor < fuzzy.CAP:
                rest = np.flatnonzero(~held)
                score[rest] = self._blend(names, n[rest], t[rest])
            hit = score > floor
            yield n[hit], t[hit], score[hit]

    def _tier(self, name: str, t: int) -> float:
        """Of a name that holds the term."""
        term = self.terms[t]
        if name == term:
            return fuzzy.EXACT
        if t not in self.patterns:
            self.patterns[t] = re.compile(rf"(?<!\w){re.escape(term)}(?!\w)") if re.fullmatch(r"\w+", term) else None
        if self.patterns[t] is not None and self.patterns[t].search(name):
            return fuzzy.WORD_HIT
        return fuzzy.PREFIX if name.startswith(term) else fuzzy.SUBSTRING

    def _blend(self, names: NameBlock, n: np.ndarray, t: np.ndarray) -> np.ndarray:
        ratio = fuzzy._ratio(pair_lcs(names.names, n, self.terms, t), names.lengths[n], self.lengths[t])
        token_sort = ratio.copy()
        other = np.flatnonzero(~(names.in_order[n] & self.in_order[t]))
        token_sort[other] = fuzzy._ratio(
            pair_lcs(names.sorted, n[other], self.sorted, t[other]), names.sorted_lengths[n[other]], self.sorted_lengths[t[other]]
        )
        # While no word is shared or doubled, sets of words give the same again.
        token_set = token_sort.copy()
        apart = (names.no_twice & (names.sorted_lengths > 0))[n] & self.single[t]
        both = np.flatnonzero(apart)
        shares = [not self.sets[j].isdisjoint(names.words[i]) for i, j in zip(n[both].tolist(), t[both].tolist())]
        apart[both[np.array(shares, dtype=bool)]] = False
        rest = np.flatnonzero(~apart)
        rest = rest[np.argsort(t[rest], kind="stable")]
        ends = np.flatnonzero(np.diff(t[rest], append=-1)) + 1 if len(rest) else []
        for start, end in zip([0, *ends[:-1]], ends):
            at = rest[start:end]
            token_set[at] = fuzzy.token_set_ratio([names.words[i] for i in n[at]], self.words[t[at[0]]])
        blend = fuzzy.RATIO_WEIGHT * ratio + fuzzy.TOKEN_SET_WEIGHT * token_set + fuzzy.TOKEN_SORT_WEIGHT * token_sort
        return np.minimum(np.round(blend, fuzzy.DECIMALS), fuzzy.CAP)


def pair_lcs(texts: Sequence[str], n: np.ndarray, patterns: Sequence[str], t: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence of ``texts[n]`` and ``patterns[t]``, pair by pair.

    Bit-parallel like ``fuzzy.lcs_lengths``, which takes over for patterns of more
    than 64 characters; here every pair has its own pattern.
    """
    out = np.zeros(len(n), np.int64)
    if not len(n):
        return out
    # Only the patterns that are asked for have a table.
    which, t = np.unique(t, return_inverse=True)
    patterns = [patterns[j] for j in which]
    sizes = fuzzy._lengths(patterns)
    wide = sizes[t] > WORD_BITS
    for j in np.unique(t[wide]):
        at = np.flatnonzero(t == j)
        out[at] = fuzzy.lcs_lengths([texts[i] for i in n[at]], patterns[j])
    codes = [np.frombuffer(p.encode("utf-32-le"), np.uint32) if len(p) <= WORD_BITS else np.empty(0, np.uint32) for p in patterns]
    alphabet = np.unique(np.concatenate(codes)) if codes else np.empty(0, np.uint32)
    if not len(alphabet):
        return out
    masks = np.zeros((len(patterns), len(alphabet) + 1), np.uint64)  # last column: no match
    for j, code in enumerate(codes):
        bits = np.uint64(1) << np.arange(len(code), dtype=np.uint64)
        np.bitwise_or.at(masks[j], np.searchsorted(alphabet, code), bits)
    used = np.array([(1 << len(c)) - 1 for c in codes], np.uint64)
    lengths = fuzzy._lengths(texts)
    # Similar lengths go together, so that one long text pads few others.
    order = np.flatnonzero(~wide)
    order = order[np.argsort(lengths[n[order]], kind="stable")]
    start = 0
    while start < len(order):
        end = start + 1
        # Lengths rise, so that the last row's is the block's.
        while end < len(order) and (end + 1 - start) * lengths[n[order[min(2 * end - start, len(order) - 1)]]] <= CELLS:
            end = min(2 * end - start, len(order))
        pairs = order[start:end]
        start = end
        rows, back = np.unique(n[pairs], return_inverse=True)
        block = np.array([texts[i] for i in rows])
        if not block.dtype.itemsize:
            continue
        chars = block.view(np.uint32).reshape(len(rows), -1)
        at = np.minimum(np.searchsorted(alphabet, chars), len(alphabet) - 1)
        at = np.where((alphabet[at] == chars) & (chars != 0), at, len(alphabet))
        base = t[pairs] * masks.shape[1]
        flat, state = masks.ravel(), np.full(len(pairs), np.uint64(0xFFFFFFFFFFFFFFFF))
        for here in at.T:
            mask = flat[base + here[back]]
            state = (state + (state & mask)) | (state & ~mask)
        out[pairs] = np.bitwise_count(~state & used[t[pairs]])
    return out
