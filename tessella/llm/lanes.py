"""Words of a batch of texts as numpy arrays: one pass over the UTF-8 bytes, no Python object per word.

A span of bytes gets a 64-bit hash from differences of a running polynomial sum over randomised bytes, then a finalising
mix, so hashes of words, lines and word windows cost a few array operations each. Texts are taken in chunks of about
CHUNK bytes; a longer text makes a chunk of its own, and memory stays within a few dozen bytes per byte of the chunk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 19
U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_RANDOM = np.random.Generator(np.random.PCG64(20260101))
_TABLE = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash: every input bit reaches every output bit."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U(33))
    x = x * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


def ordered(row: np.ndarray, high: np.ndarray, token: np.ndarray) -> np.ndarray:
    """Order of entries by row, then a class below 256, then token; one sort of packed keys where they fit."""
    if len(row) and int(row.max()) < 1 << 17:
        return np.argsort((row.astype(U) << U(47)) | (high.astype(U) << U(39)) | (token >> U(25)))
    return np.lexsort((token, high, row))


def distinct(row: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each (row, token) once, by row, then token."""
    if len(row) and int(row.max()) < 1 << 17:
        order = np.argsort((row.astype(U) << U(47)) | (token >> U(17)))
    else:
        order = np.lexsort((token, row))
    row, token = row[order], token[order]
    new = np.ones(len(row), bool)
    new[1:] = (token[1:] != token[:-1]) | (row[1:] != row[:-1])
    return row[new], token[new]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, CHUNK * 2)
        for i, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, U)
            steps[0] = 1
            _powers[i] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


class Words:
    """Words of a chunk: start, end (bytes), hash, doc (index in the chunk), first (offsets of each document's words)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool):
        self.data, self.offsets = data, offsets
        n = len(data)
        up, self._down = _power(n + 1)
        table = _TABLE[_LOWER] if lower else _TABLE
        self._sums = np.empty(n + 1, U)
        self._sums[0] = 0
        np.cumsum(table[data] * up[:n], out=self._sums[1:])
        self.filled = ~_SPACE[data]
        inner = offsets[(offsets > 0) & (offsets < n)]
        before = np.empty(n, bool)
        before[:1] = False
        before[1:] = self.filled[:-1]
        before[inner] = False
        after = np.empty(n, bool)
        after[-1:] = False
        after[:-1] = self.filled[1:]
        after[inner - 1] = False
        self.start = np.flatnonzero(self.filled & ~before)
        self.end = np.flatnonzero(self.filled & ~after) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(self.count)), self.count)
        self.hash = self.spans(self.start, self.end)

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of each span of bytes."""
        return mix((self._sums[end] - self._sums[start]) * self._down[start] + (end - start).astype(U) * U(0xD6E8FEB86659FD93))

    def total(self, flags: np.ndarray) -> np.ndarray:
        """Sum of a flag per byte over each document."""
        sums = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=sums[1:])
        return np.diff(sums[self.offsets])

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of each window of k words within a document, and the index of its first word."""
        n = len(self.hash) - k + 1
        if n <= 0:
            return np.empty(0, U), np.empty(0, np.int64)
        at = np.flatnonzero(self.doc[:n] == self.doc[k - 1 :])
        return self._window(at, k), at

    def _window(self, at: np.ndarray, k: int) -> np.ndarray:
        found = np.full(len(at), k, U)
        for j in range(k):
            found = found * U(_BASE) + self.hash[at + j]
        return mix(found)

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (doc, hash) of windows of k words, by doc, then hash; a document of fewer words has its whole sequence."""
        found, at = self.windows(k)
        doc = self.doc[at]
        for n in range(1, k):
            short = np.flatnonzero(self.count == n)
            if len(short):
                found = np.concatenate([found, self._window(self.first[short], n)])
                doc = np.concatenate([doc, short])
        return distinct(doc, found)


def chunks(texts: pa.Array, lower: bool) -> Iterator[tuple[int, Words]]:
    """(index of the first text, its Words) of each chunk; null counts as empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    begin = 0
    while begin < len(texts):
        end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + CHUNK, "right")) - 1)
        yield begin, Words(data[offsets[begin] : offsets[end]], offsets[begin : end + 1] - offsets[begin], lower)
        begin = end
