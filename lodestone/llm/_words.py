"""Vectorised words, word hashes and word windows over Arrow string columns.

A whole batch is one byte array. The hash of any stretch of bytes comes from prefix sums
of ``byte * base ** position`` modulo 2**64, so a batch costs a few numpy passes and no
Python loop over words. The hashes depend on content alone: no process seed, no place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
BASE, CHUNK = U(0x9E3779B97F4A7C15 | 1), 1 << 19
WORD_BASE = U(0xD6E8FEB86659FD93)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base ** i and its inverse modulo 2**64 for i up to n."""
    size = 1 << max(16, int(n).bit_length())
    for key in ((int(base), s) for s in (size, size * 2, size * 4)):
        if key in _powers:
            return _powers[key]
    with np.errstate(over="ignore"):
        inverse = U(pow(int(base), -1, 1 << 64))
        both = tuple(np.concatenate([np.ones(1, U), np.cumprod(np.full(size, b, U))]) for b in (base, inverse))
    if size <= CHUNK * 4:
        _powers[int(base), size] = both
    return both


class Words:
    """Words of some documents: ``doc`` (index of the document), ``hash``, byte ``start`` and ``end``."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, lower: bool):
        data = _LOWER[data] if lower else data
        self.bounds, self.data = bounds, data
        n = len(data)
        inside = ~_SPACE[data]
        cuts = np.zeros(n + 1, bool)
        cuts[bounds] = True
        before = np.empty(n, bool)
        if n:
            before[0] = False
            before[1:] = inside[:-1]
        self.start = np.flatnonzero(inside & (~before | cuts[:n]))
        after = np.empty(n, bool)
        if n:
            after[-1] = False
            after[:-1] = inside[1:]
        self.end = np.flatnonzero(inside & (~after | cuts[1:])) + 1
        forth, back = powers(BASE, n)
        total = np.zeros(n + 1, U)
        with np.errstate(over="ignore"):
            np.cumsum((data.astype(U) + U(1)) * forth[:n], out=total[1:])
            self.hash = mix((total[self.end] - total[self.start]) * back[self.start] + (self.end - self.start).astype(U))
        self.doc = np.searchsorted(bounds, self.start, side="right") - 1
        self.first = np.searchsorted(self.start, bounds)  # word range of document d: first[d] to first[d + 1]

    def sums(self) -> np.ndarray:
        forth, _ = powers(WORD_BASE, len(self.hash))
        out = np.zeros(len(self.hash) + 1, U)
        with np.errstate(over="ignore"):
            np.cumsum(self.hash * forth[: len(self.hash)], out=out[1:])
        return out

    def stretch(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of the word sequences start:end."""
        _, back = powers(WORD_BASE, len(self.hash))
        with np.errstate(over="ignore"):
            return mix((sums[end] - sums[start]) * back[start] + (end - start).astype(U) * U(0xA24BAED4963EE407))

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts (word index) of the windows of k words within one document, and their hashes."""
        n = len(self.hash)
        if n < k:
            return np.zeros(0, np.int64), np.zeros(0, U)
        start = np.flatnonzero(self.doc[: n - k + 1] == self.doc[k - 1 :])
        return start, self.stretch(self.sums(), start, start + k)


def documents(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the bounds of its documents; null as empty."""
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64 if pa.types.is_large_string(column.type) else np.int32)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    offsets = offsets.astype(np.int64)
    return data, offsets


def chunks(column: pa.Array, lower: bool) -> Iterator[tuple[int, int, Words]]:
    """The column in runs of rows of about CHUNK bytes (a longer document is a run of its own)."""
    data, offsets = documents(column)
    at, n = 0, len(column)
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK, side="right")) - 1)
        to = min(to, n)
        yield at, to, Words(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at], lower)
        at = to
