"""A compressed FM-index over integer sequences, searched for many patterns at once.

The Burrows-Wheeler transform is held in a wavelet matrix whose bit planes are packed into 64-bit words with a running count a
word. So that a search can ask for the earliest occurrence of what it has matched, the suffix array stands beside it in 32 bits, with its range minima by
blocks: within a block a byte each for the place of the least value up to and from there, above blocks a table of doublings. That makes some 14 bytes a
symbol in all, whatever the text.
"""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling. text: integers, the last of them 0 and found nowhere else."""
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    n, width = len(text), 1
    while True:
        shifted = np.zeros(n, np.int64)
        shifted[: n - width] = rank[width:] + 1
        key = rank * (n + 1) + shifted
        order = np.argsort(key, kind="stable")
        fresh = np.concatenate(([0], np.cumsum(key[order][1:] != key[order][:-1])))
        rank[order] = fresh
        if fresh[-1] == n - 1:
            return order
        width *= 2


class WaveletMatrix:
    def __init__(self, values: np.ndarray, sigma: int) -> None:
        self.levels = max(int(sigma - 1).bit_length(), 1)
        n = len(values)
        self._words, self._counts, self._zeros = [], [], []
        for level in range(self.levels - 1, -1, -1):
            bit = values >> level & 1
            padded = np.zeros((n // 64 + 1) * 64, np.uint8)
            padded[:n] = bit
            words = np.packbits(padded, bitorder="little").view("<u8")
            self._words.append(words)
            self._counts.append(np.concatenate(([0], np.cumsum(np.bitwise_count(words), dtype=np.int64)[:-1])).astype(np.int32))
            self._zeros.append(int(n - bit.sum()))
            values = np.concatenate((values[bit == 0], values[bit == 1]))

    @property
    def nbytes(self) -> int:
        return sum(x.nbytes for x in (*self._words, *self._counts))

    def rank(self, symbols: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """How often each symbol stands before its end, plus where the symbol's block starts in the last plane."""
        at = ends.copy()
        for k in range(self.levels):
            word = at >> 6
            below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
            ones = self._counts[k][word] + np.bitwise_count(self._words[k][word] & below)
            at = np.where(symbols >> (self.levels - 1 - k) & 1, self._zeros[k] + ones, at - ones)
        return at


class RangeMinima:
    """The least of any stretch of some 32-bit values, which are held too."""

    _BLOCK = 16

    def __init__(self, values: np.ndarray) -> None:
        n, size = len(values), self._BLOCK
        padded = np.full(-(-n // size) * size, np.iinfo(np.int32).max, np.int32)
        padded[:n] = values
        blocks = padded.reshape(-1, size)
        self._values = padded
        places = np.arange(size, dtype=np.uint8)
        ahead, behind = np.minimum.accumulate(blocks, axis=1), np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1]
        # The place of the least value up to each place, and from it on: the last place that set a new least.
        self._up_to = np.maximum.accumulate(np.where(blocks == ahead, places, 0), axis=1).astype(np.uint8).ravel()
        self._from = np.minimum.accumulate(np.where(blocks == behind, places, size - 1)[:, ::-1], axis=1)[:, ::-1].astype(np.uint8).ravel()
        self._tables, width = [blocks.min(1)], 1
        while 2 * width <= len(blocks):
            last = self._tables[-1]
            self._tables.append(np.minimum(last[: len(last) - width], last[width:]))
            width *= 2

    @property
    def nbytes(self) -> int:
        return sum(x.nbytes for x in (self._values, self._up_to, self._from, *self._tables))

    def least(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Of values low to high - 1, at least one."""
        size = self._BLOCK
        first, last = low // size, (high - 1) // size
        out = np.empty(len(low), np.int64)
        inside = np.flatnonzero(first == last)
        if len(inside):
            at, stop = low[inside], high[inside]
            best = self._values[at]
            while True:
                at = at + 1
                more = at < stop
                if not more.any():
                    break
                best = np.where(more, np.minimum(best, self._values[np.where(more, at, stop - 1)]), best)
            out[inside] = best
        across = np.flatnonzero(first < last)
        if len(across):
            a, b, at, end = first[across], last[across], low[across], high[across] - 1
            best = np.minimum(self._values[a * size + self._from[at]], self._values[b * size + self._up_to[end]])
            between = np.flatnonzero(b - a > 1)
            a, b = a[between] + 1, b[between]
            level = np.frexp((b - a).astype(np.float64))[1] - 1
            for k in np.unique(level):
                here = level == k
                table = self._tables[k]
                best[between[here]] = np.minimum(best[between[here]], np.minimum(table[a[here]], table[b[here] - (1 << int(k))]))
            out[across] = best
        return out


class FMIndex:
    """Index of a text of symbols from 1 to sigma - 1; 0 separates and is never matched."""

    def __init__(self, text: np.ndarray, sigma: int) -> None:
        text = np.append(text, 0)
        # Separators must differ for suffixes to be told apart only by what is theirs; give each its own symbol below all others.
        breaks = np.flatnonzero(text == 0)
        distinct = text.astype(np.int64) + len(breaks)
        distinct[breaks] = np.arange(len(breaks), 0, -1) - 1
        order = suffix_array(distinct)
        bwt = text[order - 1]
        self.n = len(text)
        self._wavelet = WaveletMatrix(bwt.astype(np.int64), sigma)
        counts = np.bincount(text, minlength=sigma)
        self._first = np.concatenate(([0], np.cumsum(counts)[:-1]))
        start = self._wavelet.rank(np.arange(sigma, dtype=np.int64), np.zeros(sigma, np.int64))
        self._shift = self._first - start
        self._places = RangeMinima(order)

    @property
    def nbytes(self) -> int:
        return self._wavelet.nbytes + self._places.nbytes + self._first.nbytes + self._shift.nbytes

    def extend(self, symbols: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the suffixes that start with each symbol and go on as those of its interval."""
        both = self._wavelet.rank(np.concatenate((symbols, symbols)), np.concatenate((low, high)))
        shift = self._shift[symbols]
        return both[: len(symbols)] + shift, both[len(symbols) :] + shift

    def earliest(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The least text position in each interval; intervals aren't empty."""
        return self._places.least(low, high)


def earlier_spans(index: FMIndex, query: np.ndarray, starts: np.ndarray, ends: np.ndarray, limit: np.ndarray, wanted: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Matching statistics, thresholded: stretches of the query, of at least `least` symbols, that occur earlier in the text.

    query: symbols, 0 where the text has none such. starts, ends: the stretches to search, all at once. limit: for each query
    position, the text position before which an occurrence of what starts there counts as earlier. wanted: by its last symbol's place, whether a window
    of `least` symbols is asked for. Every wanted window with an earlier occurrence lies in a reported span, and every reported span occurs earlier as a whole.

    A search runs from a window's end to the left as far as it goes. Where it misses, the pair of the missed symbol and its right neighbour is
    probed: if that has no earlier occurrence either, no window with both has, and the search goes on left of it.
    """
    places = np.arange(len(query))
    before = np.maximum.accumulate(np.where(wanted, places, -1))  # the last wanted window's end up to each place
    lane = np.flatnonzero(ends - starts >= least)
    left, right = starts[lane], before[ends[lane] - 1]
    alive = right - left + 1 >= least
    left, right = left[alive], right[alive]
    at, probe = right.copy(), np.full(len(right), -1, np.int64)  # probe: where to go on if the pair does occur; -1 outside a probe
    low, high = np.zeros(len(at), np.int64), np.full(len(at), index.n, np.int64)
    found_start, found_end = [], []
    while len(at):
        symbol = query[at]
        new_low, new_high = index.extend(symbol, low, high)
        fits = (symbol > 0) & (new_high > new_low)
        some = np.flatnonzero(fits)
        fits[some] = index.earliest(new_low[some], new_high[some]) < limit[at[some]]
        probing = probe >= 0
        length = right - at + fits
        edge = fits & (at == left)
        done_probe = probing & (~fits | (length == 2))
        missed = ~probing & ~fits
        report = (missed | (edge & ~probing)) & (length >= least)
        if report.any():
            found_start.append((at + ~fits)[report])
            found_end.append((right + 1)[report])
        ask = missed & (length >= 2)
        # Where a search begins anew: at the pair to probe, at the next window that may occur, or left of a pair that doesn't.
        again = np.where(length >= least, at + least - 1, right - 1)
        target = np.where(ask, at + 1, np.where(done_probe, np.where(fits, probe, right - 1), np.where(symbol == 0, at - 1, right - 1)))
        probe = np.where(ask, again, np.where(done_probe, -1, probe))
        restart = missed | done_probe
        jump = restart & ~ask
        target[jump] = np.where(target[jump] >= 0, before[target[jump]], -1)
        right = np.where(restart, target, right)
        low, high = np.where(restart, 0, new_low), np.where(restart, index.n, new_high)
        alive = np.where(jump, right - left + 1 >= least, ~(edge & ~probing))
        at = np.where(restart, target, at - 1)
        if not alive.all():
            left, right, at, low, high, probe = left[alive], right[alive], at[alive], low[alive], high[alive], probe[alive]
    if not found_start:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found_start), np.concatenate(found_end)
