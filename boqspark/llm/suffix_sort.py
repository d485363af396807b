"""Sorting places of a text by what follows them, by mergesort with hash comparisons, in numpy.

Prefix polynomial hashes give the hash of any part of the text; the common extension of two places is found by binary search
over its length, so a comparison takes a logarithmic number of hash tests and one look at the bytes behind. All merges of a
level go on at once: each place looks for its rank in the run beside its own by binary search. What has been sorted is checked
against the bytes themselves; after a collision the base of the hashes changes and the sort is done again.
"""

from __future__ import annotations

import numpy as np

_BASES = np.random.default_rng(7).integers(1, 1 << 63, 64, np.uint64) * np.uint64(8) + np.uint64(5)


class Collision(Exception):
    """Parts with equal hashes differ."""


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of a base and of its inverse modulo 2**64, n of each at least; the worker keeps those of the last base."""
    if int(base) not in _powers or len(_powers[int(base)][0]) < n:
        inverse = np.uint64(pow(int(base), -1, 1 << 64))
        _powers.clear()
        _powers[int(base)] = tuple(np.cumprod(np.r_[np.uint64(1), np.full(n, b, np.uint64)]) for b in (base, inverse))
    return _powers[int(base)]


class HashedText:
    def __init__(self, text: bytes, attempt: int = 0, bits: int = 64):
        """bits: of the hashes; fewer only to force collisions."""
        self.text = np.frombuffer(text, np.uint8)
        n = len(self.text)
        self.base, self.mask = _BASES[attempt % len(_BASES)], np.uint64((1 << bits) - 1)
        up, down = powers(self.base, n + 1)
        self.prefix = np.zeros(n + 1, np.uint64)
        np.cumsum(down[1 : n + 1] * (self.text.astype(np.uint16) + 1), out=self.prefix[1:])
        self.prefix *= up[: n + 1]  # prefix[i + 1] = prefix[i] * base + text[i] + 1

    def common(self, p: np.ndarray, q: np.ndarray, cap: np.ndarray) -> np.ndarray:
        """Length of the common extension of the places, up to the cap."""
        out = np.zeros(len(p), np.int64)
        step = 1 << int(cap.max(initial=1)).bit_length() - 1
        while step:
            power = np.uint64(pow(int(self.base), step, 1 << 64))
            at = np.flatnonzero(out + step <= cap)
            a, b = p[at] + out[at], q[at] + out[at]
            same = ((self.prefix[a + step] - self.prefix[b + step] - (self.prefix[a] - self.prefix[b]) * power) & self.mask) == 0
            out[at[same]] += step
            step >>= 1
        return out

    def order(self, p: np.ndarray, q: np.ndarray, cap: np.ndarray) -> np.ndarray:
        """-1, 0 or 1: how the parts of the length of the cap compare."""
        length = self.common(p, q, cap)
        out = np.zeros(len(p), np.int8)
        at = np.flatnonzero(length < cap)
        a, b = self.text[p[at] + length[at]], self.text[q[at] + length[at]]
        out[at] = np.where(a < b, np.int8(-1), np.int8(1))
        return out


def _merged(own: HashedText, at: np.ndarray, cap: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Places in order within each segment. begin, size: of the segment of each place. Stable."""
    now = np.arange(len(at))
    width = 1
    while True:
        i = np.flatnonzero(size > width)
        if not len(i):
            return now
        low = i - (i - begin[i]) % (2 * width)
        mid = low + width
        end = np.minimum(low + 2 * width, begin[i] + size[i])
        i, low, mid, end = (x[mid < end] for x in (i, low, mid, end))
        left = i < mid
        lo, hi = np.where(left, mid, low), np.where(left, end, mid)
        live = np.arange(len(i))
        while len(live):
            half = (lo[live] + hi[live]) // 2
            other, mine = now[half], now[i[live]]
            sign = own.order(at[other], at[mine], cap[mine])
            before = (sign < 0) | (sign == 0) & ~left[live]
            lo[live] = np.where(before, half + 1, lo[live])
            hi[live] = np.where(before, hi[live], half)
            live = live[lo[live] < hi[live]]
        out = now.copy()
        out[i + lo - mid] = now[i]
        now = out
        width *= 2


def _checked(own: HashedText, at: np.ndarray, cap: np.ndarray, again: np.ndarray) -> np.ndarray:
    """Which places say the same as the one before them. again: places whose predecessor is of the same segment. Looks at the bytes."""
    same = np.zeros(len(at), bool)
    for k in range(0, len(again), 50_000):
        i = again[k : k + 50_000]
        span = np.arange(int(cap[i].max(initial=0)))
        inside = span < cap[i][:, None]
        a, b = (own.text[np.minimum(x[:, None] + span, len(own.text) - 1)] for x in (at[i - 1], at[i]))
        differs = (a != b) & inside
        found = differs.any(axis=1)
        first = np.argmax(differs, axis=1)
        rows = np.arange(len(i))
        if (found & (a[rows, first] > b[rows, first])).any():
            raise Collision
        same[i] = ~found
    return same


def grouped(text: bytes, at: np.ndarray, cap: np.ndarray, keys: list[np.ndarray], bits: int = 64, own: HashedText | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of the places, sorted by keys (the last is the first) and then by the `cap` bytes that follow, and where a new
    group of equal ones begins. Places of equal keys have equal caps and are sorted stably. own: the text, if it is hashed already."""
    order = np.lexsort(keys) if len(at) else np.empty(0, np.int64)
    new = np.zeros(len(at), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= np.diff(k[order]) != 0
    heads = np.flatnonzero(new)
    sizes = np.diff(np.r_[heads, len(at)])
    begin, size = np.repeat(heads, sizes), np.repeat(sizes, sizes)
    for attempt in range(len(_BASES)):
        own = own if own is not None and not attempt else HashedText(text, attempt, bits)
        try:
            out = order[_merged(own, at[order], cap[order], begin, size)]
            return out, ~_checked(own, at[out], cap[out], np.flatnonzero(~new))
        except Collision:
            bits = 64 if attempt > 3 else bits
    raise Collision("no base of hashes sorts this text")
