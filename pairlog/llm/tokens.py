"""Token ids of whole texts with a public tokenizer, and their 32-bit checksums.

A byte-pair tokenizer never merges across the borders that its pre-tokenizer draws. ``Encoder`` cuts
texts at such borders (between letters, numbers, white space and the rest), has the tokenizers library
encode each distinct piece once for a worker, and puts the ids together. Where a border is not certain
(added tokens in the text, combining marks, code points that not every Unicode version knows) the
library encodes the whole text.
"""

from __future__ import annotations

import functools
import os
import unicodedata
import zlib

import numpy as np

from .words import Growing, RunTable, chunks, run_hashes, spread

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

_LETTER, _NUMBER, _OTHER, _SPACE, _UNSURE, _END = range(6)
# Unicode's White_Space property.
_WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@functools.lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Class of each code point; unsure where an old and the present Unicode differ, for combining
    marks, and for the one letter whose lower case is two characters."""
    def kind(category: str) -> int:
        return _UNSURE if category[0] == "M" or category == "Cn" else {"L": _LETTER, "N": _NUMBER}.get(category[0], _OTHER)

    old, new = unicodedata.ucd_3_2_0.category, unicodedata.category
    table = np.full(0x110000, _UNSURE, dtype=np.uint8)
    for start in (0, 0x20000):  # the planes that hold letters
        for i in range(start, start + 0x20000):
            c = chr(i)
            k = kind(new(c))
            if k == kind(old(c)):
                table[i] = k
    table[_WHITE] = _SPACE
    table[0x130] = _UNSURE
    table[0] = _END
    return table


class Encoder:
    """``spaces="kept"``: byte-level BPE whose tokens carry one leading space; ``"dropped"``: white space
    separates and vanishes; ``None``: the library sees whole texts only."""

    def __init__(self, path: str, spaces: str | None, limit: int = 1_500_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.spaces, self.table = spaces, RunTable(limit)
        self._forget()

    def _forget(self) -> None:
        self.ids, self.offset, self.length = Growing(self.dtype), Growing(np.int64), Growing(np.int64)
        self.table.clear()

    def _library(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, pieces: list[str]) -> None:
        if self.table.index.count == 0:
            self._forget()
        found = self._library(pieces)
        lengths = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        self.offset.extend(self.ids.count + np.cumsum(lengths) - lengths)
        self.length.extend(lengths)
        self.ids.extend(np.fromiter((i for x in found for i in x), dtype=self.dtype, count=int(lengths.sum())))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        out: list[np.ndarray] = []
        for start, end in chunks(texts):
            out += self._chunk(texts[start:end])
        return out

    def _chunk(self, texts: list[str]) -> list[np.ndarray]:
        whole = [i for i, t in enumerate(texts) if self.spaces is None or "\0" in t or any(a in t for a in self.added)]
        joined = "\0".join("" if i in whole else t for i, t in enumerate(texts)) + "\0" if whole else "\0".join(texts) + "\0"
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype="<u4")
        kind = _classes()[points]
        bounds = np.concatenate([[0], np.flatnonzero(kind == _END) + 1])  # of the texts
        unsure = np.flatnonzero(kind == _UNSURE)
        if len(unsure):
            whole = sorted({*whole, *(np.searchsorted(bounds, unsure, side="right") - 1).tolist()})
        starts, ends = self._cut(points, kind)
        hashes = run_hashes(points, starts, ends)
        number = self.table.numbers(hashes, lambda at: self._learn([joined[s:e] for s, e in zip(starts[at].tolist(), ends[at].tolist())]))
        lengths = self.length.data[number]
        flat = self.ids.data[spread(self.offset.data[number], lengths)]
        tokens = np.concatenate([[0], np.cumsum(lengths)])[np.searchsorted(starts, bounds)]
        out = [flat[a:b] for a, b in zip(tokens[:-1].tolist(), tokens[1:].tolist())]
        if whole:
            for i, ids in zip(whole, self._library([texts[i] for i in whole])):
                out[i] = np.array(ids, dtype=self.dtype)
        return out

    def _cut(self, points: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces that the tokenizer encodes independently of what stands around them."""
        solid = kind < _SPACE
        border = np.ones(len(kind), dtype=bool)  # a piece may begin here
        border[1:] = kind[1:] != kind[:-1]
        quote = points == 0x27
        if quote.any():  # contractions: what white space surrounds stays together
            outer = np.ones(len(kind), dtype=bool)
            outer[1:] = solid[1:] != solid[:-1]
            stretch = np.cumsum(outer)
            with_quote = np.zeros(int(stretch[-1]) + 1, dtype=bool)
            with_quote[stretch[quote]] = True
            border &= outer | ~with_quote[stretch]
        if self.spaces == "dropped":
            first = np.flatnonzero(border & solid)
            past = np.flatnonzero(border | ~solid)
            past = np.append(past, len(kind))
            return first, past[np.searchsorted(past, first, side="right")]
        white = kind == _SPACE
        last = np.zeros(len(kind), dtype=bool)  # the last white space before something solid
        last[:-1] = white[:-1] & solid[1:]
        border |= last
        joins = np.zeros(len(kind), dtype=bool)  # a single blank leads what follows
        joins[1:] = last[:-1] & (points[:-1] == 0x20)
        border &= ~joins
        end = kind == _END
        first = np.flatnonzero(border)
        past = np.append(first[1:], len(kind))
        keep = ~end[first]
        return first[keep], past[keep]


_ENCODERS: dict[tuple, Encoder] = {}


def encoder(path: str | None, name: str, spaces: str | None) -> Encoder:
    """One encoder for each Python worker; ``path`` None: the public file ``name``."""
    key = (path, name, spaces)
    if key not in _ENCODERS:
        if path is None:
            import public_tokenizers

            path = public_tokenizers.path(name)
        _ENCODERS[key] = Encoder(path, spaces)
    return _ENCODERS[key]


def checksum(ids: np.ndarray) -> int:
    """crc32 of the ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.astype("<u4").tobytes())
