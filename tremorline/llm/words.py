"""Words of Arrow text columns as 64-bit hashes, computed for about a megabyte of texts at a time with numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)

_powers = np.ones(1, dtype=np.uint64)
_inverses = np.ones(1, dtype=np.uint64)

SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
PUNCTUATION = SPACE.copy()
PUNCTUATION[[c for c in range(33, 127) if not chr(c).isalnum()]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _series(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _grow(n: int) -> None:
    global _powers, _inverses
    if len(_powers) < n:
        size = max(n, 2 * CHUNK_BYTES)
        _powers, _inverses = _series(BASE, size), _series(INVERSE, size)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Chunk:
    """The texts ``first`` to ``last`` (exclusive) of a column: lower-cased bytes and their words.

    ``start`` and ``end`` are byte positions of the words, ``doc`` the text of each (0 = ``first``), ``counts`` the words
    per text.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, first: int, last: int, breaks: np.ndarray = SPACE):
        self.first, self.last = first, last
        self.raw = data[offsets[first] : offsets[last]]
        edges = (offsets[first : last + 1] - offsets[first]).astype(np.int64)
        self.edges = edges
        self.bytes = LOWER[self.raw]
        inside = np.zeros(len(self.raw) + 2, dtype=bool)
        inside[1:-1] = ~breaks[self.raw]
        before = inside[:-1].copy()  # before[i]: byte i-1 belongs to a word of the same text
        before[edges] = False
        after = inside[1:].copy()  # after[i]: byte i belongs to a word
        starts = after[:-1] & ~before[:-1]
        self.start = np.flatnonzero(starts)
        follows = after.copy()
        follows[edges] = False
        ends = inside[:-1] & ~follows
        self.end = np.flatnonzero(ends)
        self.counts = np.diff(np.searchsorted(self.start, edges))
        self.doc = np.repeat(np.arange(last - first), self.counts)
        self._sums: np.ndarray | None = None

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of byte ranges; equal bytes have equal hashes in every chunk."""
        n = len(self.bytes)
        if self._sums is None:
            _grow(n + 1)
            self._sums = np.zeros(n + 1, dtype=np.uint64)
            np.cumsum((self.bytes.astype(np.uint64) + np.uint64(1)) * _powers[:n], out=self._sums[1:])
        return mix((self._sums[end] - self._sums[start]) * _inverses[start] + (end - start).astype(np.uint64))

    def words(self) -> np.ndarray:
        return self.hash(self.start, self.end)

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash, text, first word) of every run of ``k`` words; a text of fewer words has one run of them all."""
        words = self.words()
        stop = np.cumsum(self.counts)
        begin = stop - self.counts
        per = np.where(self.counts > 0, np.maximum(self.counts - k + 1, 1), 0)
        doc = np.repeat(np.arange(len(per)), per)
        first = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per) + begin[doc]
        out = np.zeros(len(doc), dtype=np.uint64)
        for j in range(k):
            at = first + j
            real = at < stop[doc]
            value = np.where(real, words[np.minimum(at, max(len(words) - 1, 0))], np.uint64(0)) if len(words) else out
            out = out * np.uint64(BASE) + value
        return mix(out), doc, first


def chunks(column: pa.Array, breaks: np.ndarray = SPACE, size: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Cut a text column without nulls into chunks; a text longer than ``size`` is a chunk of its own."""
    wide = pa.types.is_large_string(column.type)
    buffers = column.buffers()
    kind = np.int64 if wide else np.int32
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(buffers[1], dtype=kind)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] else np.zeros(0, dtype=np.uint8)
    a = 0
    while a < n:
        b = max(int(np.searchsorted(offsets, offsets[a] + size, "right")) - 1, a + 1)
        b = min(b, n)
        yield Chunk(data, offsets, a, b, breaks)
        a = b
