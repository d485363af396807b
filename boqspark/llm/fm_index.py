"""A compressed FM-index over sequences of small integers, in numpy: wavelet matrix with packed bits and backward search."""

from __future__ import annotations

import numpy as np

#: Order of places that never count as earlier ones.
NOWHERE = np.iinfo(np.int32).max
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: The bits below each place of a word.
_BELOW = (np.uint64(1) << np.arange(64, dtype=np.uint64)) - np.uint64(1)


def suffix_array(rank: np.ndarray, reach: int) -> np.ndarray:
    """Order of the suffixes by prefix doubling, from as many symbols on (four at most) as fit in one number. rank: symbol ranks, no two
    suffixes equal beyond `reach` symbols."""
    n = len(rank)
    base = int(rank.max(initial=0)) + 2
    step = next(w for w in (4, 3, 2, 1) if base**w < 1 << 63)
    key = np.zeros(n, np.int64)
    for j in range(step):
        key *= base
        key[: max(0, n - j)] += rank[j:] + 1
    while True:
        order = np.argsort(key)
        own = key[order]
        if step > reach or n == 0:
            return order
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.r_[False, own[1:] != own[:-1]])
        if rank[order[-1]] == n - 1:
            return order
        key = rank * (n + 2)
        key[: max(0, n - step)] += rank[step:] + 1
        step *= 2


class WaveletMatrix:
    """Rank of a symbol in a prefix of a sequence, one packed bit vector per binary digit."""

    def __init__(self, symbols: np.ndarray):
        self.levels = max(1, int(symbols.max(initial=0)).bit_length())
        self.words, self.before, self.zeros = [], [], []
        s = symbols.astype(np.int64)
        for level in range(self.levels - 1, -1, -1):
            bit = (s >> level & 1).astype(np.uint8)
            padded = np.zeros((len(bit) // 64 + 1) * 64, np.uint8)
            padded[: len(bit)] = bit
            words = np.packbits(padded, bitorder="little").view(np.uint64)
            self.words.append(words)
            self.before.append(np.r_[0, np.cumsum(np.bitwise_count(words))[:-1]].astype(np.int64))
            self.zeros.append(len(bit) - int(bit.sum()))
            s = np.concatenate([s[bit == 0], s[bit == 1]])

    def place(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where prefix ends `at` (one row or several) go in the last level on the way of the symbol; differences of two are counts."""
        for k in range(self.levels):
            block = at >> 6
            inside = self.words[k].take(block)
            inside &= _BELOW.take(at & 63)
            ones = self.before[k].take(block)
            ones += np.bitwise_count(inside)
            at = np.where(symbol & 1 << self.levels - 1 - k, ones + self.zeros[k], at - ones)
        return at


class FMIndex:
    """Texts of symbols >= 1, each closed by a 0. Closing zeros count as different symbols, in the order of their texts.

    Kept are the wavelet matrix and, if `order` gives the order of each place of the text, that of each suffix in 32 bits;
    neither the text nor the suffix array.
    """

    def __init__(self, text: np.ndarray, reach: int, order: np.ndarray | None = None):
        ends = text == 0
        n_ends = int(ends.sum())
        rank = text.astype(np.int64) + n_ends
        rank[ends] = np.arange(n_ends)
        suffixes = suffix_array(rank, reach)
        self.size = len(text)
        self.wavelet = WaveletMatrix(text[suffixes - 1])
        counts = np.bincount(text, minlength=int(text.max(initial=0)) + 1)
        self.first = np.r_[0, np.cumsum(counts)[:-1]]
        self.base = self.wavelet.place(np.arange(len(counts)), np.zeros(len(counts), np.int64))
        self.order = None if order is None else np.append(order[suffixes], NOWHERE).astype(np.int32)

    def extend(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One step of backward search."""
        shift = self.first[symbol] - self.base[symbol]
        lo, hi = shift + self.wavelet.place(symbol, np.stack([lo, hi]))
        return lo, hi

    def _least(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Least order of the suffixes of each interval."""
        spans, own = np.unique(lo * (self.size + 1) + hi, return_inverse=True)
        a, b = spans // (self.size + 1), spans % (self.size + 1)
        return np.minimum.reduceat(self.order, np.stack([a, b], axis=1).ravel())[::2][own.ravel()]

    def statistics(self, text: np.ndarray, ends: np.ndarray, order: np.ndarray, least: int) -> np.ndarray:
        """Matching statistics of a streamed text: for each end the length of the longest part before it that also stands at
        an earlier place of the index than its own; 0 where that is under `least`. order: of the places of the text.

        Backward search over the wavelet matrix, a word at a time for all ends at once. An end is done when only its own
        place is left, when its text begins, or when no place of the interval is an earlier one: parts of a part that
        stands earlier stand earlier too, so the longest one is the last that did. Ends with equal words before them follow each
        other, and neighbours with the same interval and word take one step together.
        """
        out = np.zeros(len(ends), np.int64)
        tails = np.zeros(len(ends), np.uint64)
        for j in range(1, least + 1):
            tails = tails * _BASE + text[np.maximum(ends - j, 0)].astype(np.uint64)
        live = np.argsort(tails)
        lo, hi = np.zeros(len(ends), np.int64), np.full(len(ends), self.size, np.int64)
        length = 0
        while len(live):
            length += 1
            at = ends[live] - length
            inside = at >= 0
            inside[inside] = text[at[inside]] != 0
            live, lo, hi, at = live[inside], lo[inside], hi[inside], at[inside]
            symbol = text[at]
            new = np.r_[True, (symbol[1:] != symbol[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])][: len(live)]
            lo, hi = self.extend(symbol[new], lo[new], hi[new])
            own = np.cumsum(new) - 1
            several = hi - lo > 1  # more than its own place
            more = several[own]
            if length >= least:
                earliest = np.full(len(lo), NOWHERE, np.int64)
                if several.any():
                    earliest[several] = self._least(lo[several], hi[several])
                more &= earliest[own] < order[at]
                out[live[more]] = length
            lo, hi = lo[own], hi[own]
            live, lo, hi = live[more], lo[more], hi[more]
        return out
