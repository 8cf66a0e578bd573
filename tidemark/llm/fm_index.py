"""An FM-index over integer symbols: suffix order by doubling, the BWT in a wavelet matrix, batched backward search."""

from __future__ import annotations

import numpy as np

U64 = np.uint64
BELOW = (U64(1) << np.arange(64, dtype=U64)) - U64(1)  # masks of the bits below each place


class WaveletMatrix:
    """Rank over a sequence of symbols below `sigma`: one packed bit vector with block counts per symbol bit."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.levels = max(1, int(sigma - 1).bit_length())
        self.words, self.before, self.zeros = [], [], []
        n = len(symbols)
        current = symbols.astype(np.int32)
        for level in range(self.levels - 1, -1, -1):
            bits = ((current >> level) & 1).astype(bool)
            padded = np.zeros((n // 64 + 1) * 64, bool)
            padded[:n] = bits
            packed = np.packbits(padded, bitorder="little").view(U64)
            counts = np.zeros(len(packed) + 1, np.int32)
            np.cumsum(np.bitwise_count(packed), out=counts[1:])
            self.words.append(packed)
            self.before.append(counts[:-1])
            self.zeros.append(np.int32(n - int(counts[-1])))
            current = np.concatenate([current[~bits], current[bits]])

        # where the run of each symbol starts at the bottom: its rank path from position 0
        every = np.arange(sigma, dtype=np.int32)
        self.start = self._descend(every, np.zeros(sigma, np.int32))

    def _descend(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        for step, (words, before, zeros) in enumerate(zip(self.words, self.before, self.zeros)):
            block = at >> 6
            ones = before[block] + np.bitwise_count(words[block] & BELOW[at & 63])
            bit = (symbols >> (self.levels - 1 - step)) & 1
            at = np.where(bit, ones + zeros, at - ones)
        return at

    def rank(self, symbols: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How often each symbol stands before `lo` and before `hi`."""
        k = len(symbols)
        at = self._descend(np.concatenate([symbols, symbols]), np.concatenate([lo, hi])) - np.tile(self.start[symbols], 2)
        return at[:k], at[k:]


def suffix_order(text: np.ndarray, context: int) -> np.ndarray:
    """Positions ordered by the `context` (or more) symbols that begin there; text end is smallest."""
    n = len(text)
    order = np.argsort(text, kind="stable")
    rank = np.zeros(n + 1, np.int64)
    ordered = text[order]
    rank[order] = np.cumsum(np.concatenate([[1], ordered[1:] != ordered[:-1]]))
    have = 1
    while have < context:
        second = np.zeros(n, np.int64)
        if have < n:
            second[: n - have] = rank[have:n]
        key = rank[:n] * (n + 1) + second
        order = np.argsort(key)
        ordered = key[order]
        fresh = np.zeros(n + 1, np.int64)
        fresh[order] = np.cumsum(np.concatenate([[1], ordered[1:] != ordered[:-1]]))
        rank, have = fresh, have * 2
        if rank.max() == n:
            break
    return order


class FMIndex:
    """Counts and locates patterns of up to `context` symbols.

    Suffixes are ordered by their first `context` symbols at least; that order
    suffices for backward search of patterns that long.  Symbols are 1..sigma-1;
    0 separates texts and never matches.
    """

    def __init__(self, text: np.ndarray, sigma: int, context: int):
        self.text = text.astype(np.int32)
        self.order = suffix_order(text, context)
        counts = np.bincount(text, minlength=sigma)
        self.first = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
        self.bwt = WaveletMatrix(text[self.order - 1], sigma)  # position 0 is preceded by the last separator

    def matches(self, starts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Suffix intervals [lo, hi) of the patterns text[start:start+size], searched backward together.

        Every pattern stands in the text itself, so a pattern whose interval is
        down to one row has no other occurrence and leaves the search; it is
        returned as (-1, 0).
        """
        lo = np.full(len(starts), -1, np.int64)
        hi = np.zeros(len(starts), np.int64)
        live = np.arange(len(starts))
        symbol = self.text[starts + size - 1]
        a, b = self.first[symbol], self.first[symbol + 1]
        for step in range(size - 2, -1, -1):
            more = b - a > 1
            live, a, b = live[more], a[more], b[more]
            if not len(live):
                return lo, hi
            symbol = self.text[starts[live] + step]
            ra, rb = self.bwt.rank(symbol, a, b)
            a, b = self.first[symbol] + ra, self.first[symbol] + rb
        more = b - a > 1
        lo[live[more]], hi[live[more]] = a[more], b[more]
        return lo, hi


def earlier_copies(segments: list[np.ndarray], order_major: np.ndarray, order_minor: np.ndarray, size: int) -> list[np.ndarray]:
    """For every `size`-symbol window of every segment: does an equal window stand earlier?

    Segments are arrays of 64-bit symbols; the place of a window is
    (order_major, order_minor + offset of the window in its segment).
    """
    lengths = np.array([len(s) for s in segments])
    names, dense = np.unique(np.concatenate(segments), return_inverse=True)
    begin = np.concatenate([[0], np.cumsum(lengths + 1)])
    text = np.zeros(begin[-1], np.int64)
    body = np.ones(len(text), bool)
    body[begin[1:] - 1] = False
    text[body] = dense + 1
    index = FMIndex(text, len(names) + 1, size)
    windows = lengths - size + 1
    owner = np.repeat(np.arange(len(segments)), windows)
    offset = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
    starts = begin[owner] + offset
    place = np.full(len(text), len(text), np.int64)  # rank of each window start in reading order
    by = np.lexsort((order_minor[owner] + offset, order_major[owner]))
    major, minor = order_major[owner][by], (order_minor[owner] + offset)[by]
    fresh = np.ones(len(by), bool)
    fresh[1:] = (major[1:] != major[:-1]) | (minor[1:] != minor[:-1])
    place[starts[by]] = np.cumsum(fresh)
    lo, hi = index.matches(starts, size)
    found = np.flatnonzero(lo >= 0)
    marked = np.zeros(len(starts), bool)
    if len(found):
        edge, which = np.unique(lo[found], return_inverse=True)
        end = np.zeros(len(edge), np.int64)
        end[which] = hi[found]
        bounds = np.stack([edge, end], 1).ravel()
        places = np.append(place[index.order], len(text))
        least = np.minimum.reduceat(places, bounds)[::2]
        marked[found] = least[which] < place[starts[found]]
    return np.split(marked, np.cumsum(windows)[:-1])
