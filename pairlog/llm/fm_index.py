"""FM-index over a text of integer symbols: suffix order, wavelet matrix, sampled positions; all numpy.

The text is a chain of runs; each run is closed by a separator that sorts by its place and matches nothing.
"""

from __future__ import annotations

import numpy as np


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Positions sorted by suffix, by prefix doubling. Symbol 0 is a separator; separators differ by place."""
    n = len(symbols)
    separator = symbols == 0
    first = symbols.astype(np.int64) + int(separator.sum())
    first[separator] = np.arange(int(separator.sum()))
    order = np.argsort(first, kind="stable")
    rank = np.empty(n, dtype=np.int64)  # the first place of the suffixes that are equal so far
    rank[order] = np.searchsorted(first[order], first[order])
    width = 1
    while True:
        sorted_rank = rank[order]
        tied = np.zeros(n, dtype=bool)
        same = sorted_rank[1:] == sorted_rank[:-1]
        tied[1:] |= same
        tied[:-1] |= same
        places = np.flatnonzero(tied)  # only what is still tied is sorted again
        if not len(places):
            return order
        some = order[places]
        after = some + width
        second = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        again = np.lexsort((second, rank[some]))
        some, second = some[again], second[again]
        order[places] = some
        # a new rank begins where the old rank or the second key changes; ranks are first places
        old = rank[some]
        new = np.ones(len(some), dtype=bool)
        new[1:] = (old[1:] != old[:-1]) | (second[1:] != second[:-1])
        index = np.arange(len(some))
        head = np.maximum.accumulate(np.where(new, index, 0))
        group = np.maximum.accumulate(np.where(np.concatenate([[True], old[1:] != old[:-1]]), index, 0))
        rank[some] = old + head - group
        width *= 2


class WaveletMatrix:
    """rank(symbol, i): how often a symbol stands before place i. One bit vector per bit of the symbols,
    with counts per 64-bit word; zeros go left at each level."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits, self.n = bits, len(symbols)
        self.words: list[np.ndarray] = []
        self.before: list[np.ndarray] = []
        self.zeros: list[int] = []
        now = symbols
        for level in range(bits - 1, -1, -1):
            bit = ((now >> level) & 1).astype(bool)
            padded = np.zeros((self.n // 64 + 1) * 64, dtype=bool)
            padded[:self.n] = bit
            words = np.packbits(padded, bitorder="little").view("<u8")
            before = np.zeros(len(words) + 1, dtype=np.int32)
            np.cumsum(np.bitwise_count(words), out=before[1:])
            self.words.append(words)
            self.before.append(before)
            self.zeros.append(int(self.n - before[-1]))
            now = np.concatenate([now[~bit], now[bit]])

    def ones(self, level: int, place: np.ndarray) -> np.ndarray:
        word = place >> 6
        below = (np.uint64(1) << (place & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[level][word] + np.bitwise_count(self.words[level][word] & below).astype(np.int64)

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        start = np.zeros_like(place)
        for k in range(self.bits):
            bit = (symbol >> (self.bits - 1 - k)) & 1 == 1
            a, b = self.ones(k, start), self.ones(k, place)
            start = np.where(bit, self.zeros[k] + a, start - a)
            place = np.where(bit, self.zeros[k] + b, place - b)
        return place - start

    def access(self, place: np.ndarray) -> np.ndarray:
        symbol = np.zeros_like(place)
        for k in range(self.bits):
            word = place >> 6
            bit = (self.words[k][word] >> (place & 63).astype(np.uint64)) & np.uint64(1) == 1
            ones = self.ones(k, place)
            symbol = (symbol << 1) | bit
            place = np.where(bit, self.zeros[k] + ones, place - ones)
        return symbol


class FMIndex:
    """Counts and finds patterns of symbols 1 .. ``alphabet`` in ``symbols`` (0 separates runs and ends the
    text). Every ``sample``-th position and each run's first is stored; others are walked to."""

    def __init__(self, symbols: np.ndarray, alphabet: int, sample: int = 16):
        order = suffix_order(symbols)
        n = len(symbols)
        self.alphabet, self.n = alphabet, n
        last = symbols[order - 1]  # the symbol before each suffix; the text's end stands before its start
        self.less = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=alphabet + 1))]).astype(np.int64)
        self.wavelet = WaveletMatrix(last.astype(np.int64), max(1, int(alphabet).bit_length()))
        kept = (order % sample == 0) | (last == 0)
        self.kept = np.flatnonzero(kept)
        self.positions = order[kept]
        self.is_kept = kept

    def ranges(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search for equally long patterns (rows) at once: ranges of suffixes that begin so."""
        low = np.zeros(len(patterns), dtype=np.int64)
        high = np.full(len(patterns), self.n, dtype=np.int64)
        alive = np.arange(len(patterns))
        for column in range(patterns.shape[1] - 1, -1, -1):
            symbol = patterns[alive, column]
            a = self.less[symbol] + self.wavelet.rank(symbol, low[alive])
            b = self.less[symbol] + self.wavelet.rank(symbol, high[alive])
            low[alive], high[alive] = a, b
            alive = alive[b > a]
            if not len(alive):
                break
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffixes: walk back to the next stored position."""
        out = np.zeros(len(rows), dtype=np.int64)
        on, steps = np.arange(len(rows)), 0
        row = rows.copy()
        while len(on):
            stored = self.is_kept[row]
            out[on[stored]] = self.positions[np.searchsorted(self.kept, row[stored])] + steps
            on, row = on[~stored], row[~stored]
            symbol = self.wavelet.access(row)
            row = self.less[symbol] + self.wavelet.rank(symbol, row)
            steps += 1
        return out
