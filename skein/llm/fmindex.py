"""An FM-index over integer sequences: wavelet-matrix ranks and sampled suffix positions.

A sequence consists of symbols from 1 up and of separators, 0.  Separators count as distinct
symbols in order of their positions, so suffixes compare as if they ended there and suffix
sorting never looks beyond one.  Everything is vectorised over many patterns at once.
"""

from __future__ import annotations

import numpy as np


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """Positions of ``seq`` (ending in a separator) in the order of their suffixes.

    The first sort packs as many symbols as fit 62 bits; then the order is doubled, sorting
    again only groups that are still tied.  A separator inside the packed symbols decides a
    tie by position, which a stable sort already gives.
    """
    n = len(seq)
    bits = max(1, int(seq.max()).bit_length())
    width = min(62 // bits, 16, n)
    key = np.zeros(n, np.uint64)
    open_ = np.ones(n, bool)
    for k in range(width):
        at = seq[k:] if k else seq
        part = np.zeros(n, np.uint64)
        part[: n - k] = at
        open_[n - k :] = False
        part[~open_] = 0
        open_ &= part != 0
        key = (key << np.uint64(bits)) | part
    order = np.argsort(key, kind="stable")
    tied = open_[order]
    same = np.zeros(n, bool)  # whether a row ties with the row above it
    same[1:] = (key[order][1:] == key[order][:-1]) & tied[1:] & tied[:-1]
    del key, open_, tied
    rank = np.empty(n, np.int64)
    step = width
    while True:
        first = np.maximum.accumulate(np.where(same, 0, np.arange(n)))
        rank[order] = first
        loose = same.copy()
        loose[:-1] |= same[1:]
        rows = np.flatnonzero(loose)
        if not len(rows):
            return order
        at = order[rows]
        then = rank[np.minimum(at + step, n - 1)]
        own = first[rows]
        new = np.lexsort((then, own))
        order[rows] = at[new]
        own, then = own[new], then[new]
        same[rows[1:]] = (own[1:] == own[:-1]) & (then[1:] == then[:-1])
        same[rows[0]] = False
        step *= 2


class WaveletMatrix:
    """Ranks over a sequence of symbols below ``2 ** bits``."""

    def __init__(self, seq: np.ndarray, bits: int) -> None:
        self.n, self.bits = len(seq), bits
        self.words: list[np.ndarray] = []
        self.before: list[np.ndarray] = []
        self.zeros: list[int] = []
        for level in range(bits - 1, -1, -1):
            bit = (seq >> level) & 1
            padded = np.zeros((self.n // 64 + 1) * 64, np.uint8)
            padded[: self.n] = bit
            words = np.packbits(padded, bitorder="little").view(np.uint64)
            before = np.zeros(len(words) + 1, np.int64)
            np.cumsum(np.bitwise_count(words), out=before[1:])
            self.words.append(words)
            self.before.append(before)
            self.zeros.append(self.n - int(before[-1]))
            seq = np.concatenate([seq[bit == 0], seq[bit == 1]])

    def _ones(self, k: int, i: np.ndarray) -> np.ndarray:
        word, off = i >> 6, (i & 63).astype(np.uint64)
        mask = (np.uint64(1) << off) - np.uint64(1)
        return self.before[k][word] + np.bitwise_count(self.words[k][word] & mask)

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each ``c`` occurs in front of position ``i``."""
        s, e = np.zeros_like(i), i.copy()
        for k in range(self.bits):
            one = ((c >> (self.bits - 1 - k)) & 1).astype(bool)
            os_, oe = self._ones(k, s), self._ones(k, e)
            s = np.where(one, self.zeros[k] + os_, s - os_)
            e = np.where(one, self.zeros[k] + oe, e - oe)
        return e - s

    def access(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols at ``i`` and how often each occurs in front of its position."""
        s, e, c = np.zeros_like(i), i.copy(), np.zeros_like(i)
        for k in range(self.bits):
            one = ((self.words[k][e >> 6] >> (e & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)
            os_, oe = self._ones(k, s), self._ones(k, e)
            s = np.where(one, self.zeros[k] + os_, s - os_)
            e = np.where(one, self.zeros[k] + oe, e - oe)
            c = (c << 1) | one
        return c, e - s


class FMIndex:
    """Counts and locates patterns in a sequence that ends in a separator."""

    def __init__(self, seq: np.ndarray, sample: int = 16) -> None:
        seq = np.asarray(seq, np.int64)
        if not len(seq) or seq[-1] != 0:
            seq = np.append(seq, 0)
        self.n = len(seq)
        order = suffix_array(seq)
        last = seq[order - 1]  # in front of position 0 stands the last separator
        bits = max(1, int(seq.max()).bit_length())
        self.top = int(seq.max())
        self.tree = WaveletMatrix(last, bits)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(seq, minlength=self.top + 1))]).astype(np.int64)
        # Rows behind a separator have no step to the left, so they are sampled as well.
        known = (order % sample == 0) | (last == 0)
        self.known = known
        self.place = np.cumsum(known) - 1
        self.values = order[known]

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of left-aligned ``patterns``, by backward search."""
        m = len(patterns)
        lo, hi = np.zeros(m, np.int64), np.full(m, self.n, np.int64)
        for step in range(int(lengths.max()) if m else 0):
            live = np.flatnonzero((step < lengths) & (lo < hi))
            if not len(live):
                break
            c = patterns[live, lengths[live] - 1 - step].astype(np.int64)
            inside = (c >= 1) & (c <= self.top)
            lo[live[~inside]] = hi[live[~inside]] = 0
            live, c = live[inside], c[inside]
            at = self.tree.rank(np.concatenate([c, c]), np.concatenate([lo[live], hi[live]]))
            lo[live] = self.first[c] + at[: len(c)]
            hi[live] = self.first[c] + at[len(c) :]
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows."""
        out, at = np.zeros(len(rows), np.int64), rows.astype(np.int64).copy()
        walked = np.zeros(len(rows), np.int64)
        todo = np.arange(len(rows))
        while len(todo):
            here = at[todo]
            done = self.known[here]
            ended = todo[done]
            out[ended] = self.values[self.place[here[done]]] + walked[ended]
            todo = todo[~done]
            c, before = self.tree.access(at[todo])
            at[todo] = self.first[c] + before
            walked[todo] += 1
        return out
