"""Runs of characters in many texts at once: numpy cuts them, hashes them and looks them up.

A task sees its texts in chunks of bounded size (``chunks``), joined with one separator behind each
text. All per-word work is a few passes over those arrays; Python touches a word only when it is new
to the worker (``RunTable``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

CHUNK = 1 << 19
_POWERS = np.ones(1, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15 | 1


def chunks(texts: list, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``limit`` characters together; a longer text is a range of its own."""
    start = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text) > limit:
            yield start, i
            start, size = i, 0
        size += len(text) + 1
    if start < len(texts):
        yield start, len(texts)


def byte_class(pattern_ranges: list[tuple[int, int]]) -> np.ndarray:
    """A 256-entry table, true for the bytes that belong to words."""
    table = np.zeros(256, dtype=bool)
    for low, high in pattern_ranges:
        table[low:high + 1] = True
    return table


#: [^\x00-\x2F\x3A-\x60\x7B-\x7F]: digits, lower-case letters, everything beyond ASCII
WORD_BYTES = byte_class([(0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF)])
#: [^\x20\x09-\x0D]
SOLID_BYTES = ~byte_class([(0x20, 0x20), (0x09, 0x0D)])


def join_bytes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The texts, ASCII letters lower-cased, a line end behind each; and where each text starts
    (one entry more than texts)."""
    data = b"\n".join(texts).lower() + b"\n"
    starts = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=starts[1:])
    return np.frombuffer(data, dtype=np.uint8), starts


def runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and past-last index of each stretch of true values."""
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(inside) and inside[0]:
        edge = np.concatenate(([0], edge))
    if len(inside) and inside[-1]:
        edge = np.append(edge, len(inside))
    return edge[0::2], edge[1::2]


def owner(starts: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How many runs begin before each text bound: with ``np.diff``, the runs of each text."""
    return np.searchsorted(starts, bounds)


def powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        step = np.full(max(n, 64), _BASE, dtype=np.uint64)
        step[0] = 1
        _POWERS = np.multiply.accumulate(step)
    return _POWERS


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    h = h ^ (h >> np.uint64(31))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(30)
    return h


def run_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of ``values`` (bytes or code points); it depends on the run alone. Every symbol is
    mixed together with its place before the sum: a sum that is linear in the symbols, such as a polynomial
    modulo 2^64, has whole families of unlike words with one hash."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    lengths = ends - starts
    total = int(lengths.sum())
    base = np.cumsum(lengths) - lengths
    at = np.arange(total, dtype=np.int64)
    within = at - np.repeat(base, lengths)
    terms = values[np.repeat(starts, lengths) + within].astype(np.uint64) + np.uint64(1)
    terms += within.astype(np.uint64) << np.uint64(21)  # code points have 21 bits
    return mix(np.add.reduceat(mix(terms), base) + lengths.astype(np.uint64))


def spread(offsets: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices that lay the slices ``offsets[i] : offsets[i] + lengths[i]`` one behind the other."""
    base = np.cumsum(lengths) - lengths
    return np.arange(int(lengths.sum()), dtype=np.int64) + np.repeat(offsets - base, lengths)


class Growing:
    """An array that is appended to; ``data`` may be longer than ``count``."""

    def __init__(self, dtype, shape: tuple[int, ...] = ()):
        self.data, self.count = np.zeros((1 << 10, *shape), dtype=dtype), 0

    def extend(self, rows: np.ndarray) -> None:
        end = self.count + len(rows)
        if end > len(self.data):
            more = np.zeros((max(end, 2 * len(self.data)), *self.data.shape[1:]), dtype=self.data.dtype)
            more[:self.count] = self.data[:self.count]
            self.data = more
        self.data[self.count:end] = rows
        self.count = end


class HashIndex:
    """64-bit hash -> entry number, open addressing in numpy arrays; -1 where absent."""

    def __init__(self, capacity: int = 1 << 16):
        self._allot(capacity)
        self.count = 0

    def _allot(self, capacity: int) -> None:
        self.mask = capacity - 1
        self.keys = np.zeros(capacity, dtype=np.uint64)
        self.entry = np.full(capacity, -1, dtype=np.int32)

    def find(self, h: np.ndarray) -> np.ndarray:
        out = np.full(len(h), -1, dtype=np.int32)
        slot = (h & np.uint64(self.mask)).astype(np.int64)
        rest = None
        while len(slot):
            entry = self.entry[slot]
            hit = (self.keys[slot] == (h if rest is None else h[rest])) & (entry >= 0)
            on = np.flatnonzero(~hit & (entry >= 0))
            if rest is None:
                np.copyto(out, entry, where=hit)
                rest = on
            else:
                out[rest[hit]] = entry[hit]
                rest = rest[on]
            slot = (slot[on] + 1) & self.mask
        return out

    def add(self, h: np.ndarray) -> np.ndarray:
        """Entry numbers for hashes which are distinct and not present yet."""
        first = self.count
        self.count += len(h)
        if self.count * 2 > self.mask:
            keys, entry = self.keys[self.entry >= 0], self.entry[self.entry >= 0]
            self._allot(1 << (int(self.count * 3).bit_length()))
            self._put(keys, entry)
        numbers = np.arange(first, self.count, dtype=np.int32)
        self._put(h, numbers)
        return numbers

    def _put(self, h: np.ndarray, entry: np.ndarray) -> None:
        slot = (h & np.uint64(self.mask)).astype(np.int64)
        while len(h):
            free = np.flatnonzero(self.entry[slot] < 0)
            self.entry[slot[free]] = entry[free]  # of several for one place the last stays
            won = free[self.entry[slot[free]] == entry[free]]
            self.keys[slot[won]] = h[won]
            left = np.ones(len(h), dtype=bool)
            left[won] = False
            h, entry, slot = h[left], entry[left], (slot[left] + 1) & self.mask


class RunTable:
    """What a worker knows of the runs it has met: ``compute(new runs) -> rows``, kept up to ``limit``
    entries; then it starts afresh, so memory stays bounded on any input."""

    def __init__(self, limit: int = 1_000_000):
        self.limit, self.index = limit, HashIndex()

    def clear(self) -> None:
        self.index = HashIndex()

    def numbers(self, h: np.ndarray, learn) -> np.ndarray:
        """Entry numbers of the hashes; ``learn(places)`` is called with one place in ``h`` for each
        new hash, in the order of the new entries, after ``clear`` if the table was full."""
        found = self.index.find(h)
        if (found < 0).any():
            if self.index.count > self.limit:
                self.clear()
                found[:] = -1
            missing = np.flatnonzero(found < 0)
            fresh, place, back = np.unique(h[missing], return_index=True, return_inverse=True)
            learn(missing[place])
            found[missing] = self.index.add(fresh)[back]
        return found
