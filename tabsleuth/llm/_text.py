"""Vectorised helpers over batches of texts: byte buffers, rolling hashes, words."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text bytes that a worker handles at a time (one longer text is handled alone).
SLICE_BYTES = 1 << 20

_BASE = 0x9E3779B97F4A7C55
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS = np.ones(1, dtype=np.uint64)
_INVERSES = np.ones(1, dtype=np.uint64)

#: The ASCII white space that separates words, and the fold of A-Z.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
FOLD = np.arange(256, dtype=np.uint8)
FOLD[0x41:0x5B] += 0x20


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective mixing of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POWERS, _INVERSES
    if len(_POWERS) < n:
        size = max(n, SLICE_BYTES + 1)
        p, q = np.full(size, _BASE, dtype=np.uint64), np.full(size, _INVERSE, dtype=np.uint64)
        p[0] = q[0] = 1
        p, q = np.cumprod(p, dtype=np.uint64), np.cumprod(q, dtype=np.uint64)
        if size > 2 * SLICE_BYTES:  # for one huge text: not kept
            return p, q
        _POWERS, _INVERSES = p, q
    return _POWERS, _INVERSES


class RollingHash:
    """Polynomial hashes (mod 2^64, then mixed) of any spans of a byte buffer."""

    def __init__(self, buf: np.ndarray):
        n = len(buf)
        power, self.inverse = _powers(n + 1)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * power[:n], out=self.sums[1:])

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inverse[start])

    def grams(self, k: int) -> np.ndarray:
        n = len(self.sums) - 1
        if n < k:
            return np.empty(0, dtype=np.uint64)
        return mix((self.sums[k:] - self.sums[: n - k + 1]) * self.inverse[: n - k + 1])


def byte_column(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column without nulls, and its offsets."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not (wide or pa.types.is_string(column.type) or pa.types.is_binary(column.type)):
        column = column.cast(pa.large_binary())
        wide = True
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, dtype=np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def lower_column(column: pa.Array) -> pa.Array:
    """A string column in lower case, nulls as empty; text that is not valid
    UTF-8 keeps its case (only A-Z are folded later)."""
    if column.null_count:
        column = column.fill_null("")
    try:
        return pc.utf8_lower(column)
    except pa.ArrowInvalid:
        return column


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts have ``limit`` bytes at most together, one row at least."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, min(j, n)
        i = j


def words(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the white-space separated words, and their row."""
    text = ~SPACE[buf]
    first = text.copy()
    first[1:] &= ~text[:-1]
    begin = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[begin] = text[begin]
    last = text.copy()
    last[:-1] &= ~text[1:]
    end = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    last[end] = text[end]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, np.searchsorted(offsets, start, side="right") - 1


_TOKEN = np.zeros(256, dtype=bool)
_TOKEN[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def token_spans(buf: np.ndarray, offsets: np.ndarray) -> tuple[RollingHash, np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of all texts in a buffer, that is runs of ASCII letters (A-Z
    folded), digits and bytes from 0x80 on: their hasher, starts, ends, rows."""
    folded = FOLD[buf]
    blank = np.where(_TOKEN[folded], folded, np.uint8(0x20))
    return RollingHash(blank), *words(blank, offsets)


def token_hashes(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and rows of the tokens of all texts in a buffer."""
    hasher, start, end, row = token_spans(buf, offsets)
    return hasher.spans(start, end), row


def tidy(run):
    """A task's batch function that hands freed memory back at its end: Python
    workers live on and serve other stages, whose memory this would take."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
            if trim is not None:
                trim(0)

    return tidied
