"""Vectorised word and shingle hashing that runs inside Spark tasks.

A word is ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z, taken on the UTF-8
bytes, where both rules are exact.  All functions here are small helpers of the
operators: they see one Arrow batch at a time and keep nothing between batches.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15  # 5 mod 8
_MASK = (1 << 64) - 1
CHUNK_BYTES = 1 << 16
PIECE_ROWS = 500


def _table() -> np.ndarray:
    rng = np.random.default_rng(20240607)
    t = rng.integers(1, 1 << 63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)
    for c in range(ord("A"), ord("Z") + 1):
        t[c] = t[c + 32]
    return t


BYTE_HASH = _table()
_space = np.zeros(256, bool)
_space[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


@functools.lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inv = pow(_BASE, -1, 1 << 64)
    p = np.full(n, U64(_BASE & _MASK))
    q = np.full(n, U64(inv))
    p[0] = q[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(p), np.multiply.accumulate(q)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(33))) * U64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> U64(33))) * U64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> U64(33))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its offsets (a null has no bytes)."""
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def pieces(batch: pa.RecordBatch, rows: int = PIECE_ROWS) -> Iterator[pa.RecordBatch]:
    """The rows of a batch, a few at a time: a task that hands whole texts back to the JVM never has many of them in flight."""
    for lo in range(0, len(batch), rows):
        yield batch.slice(lo, rows)


def chunks(offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents with about ``most`` bytes each; a longer document stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word and, for each document, the index of its first word (n + 1 values)."""
    inside = ~_space[raw]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < len(raw))]
    starts[cut] = inside[cut]
    ends[cut - 1] = inside[cut - 1]
    s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return s, e, np.searchsorted(s, offsets)


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each byte span, letters A-Z folded; equal spans hash alike wherever they stand."""
    if not len(starts):
        return np.zeros(0, U64)
    n = 1 << max(17, int(len(raw) + 1).bit_length())
    p, q = _powers(n)
    with np.errstate(over="ignore"):
        total = np.zeros(len(raw) + 1, U64)
        np.cumsum(BYTE_HASH[raw] * p[: len(raw)], out=total[1:])
        return mix((total[ends] - total[starts]) * q[starts] + (ends - starts).astype(U64))


_STEP = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], U64)


def shingle_hashes(w: np.ndarray, k: int = 5) -> np.ndarray:
    """Hashes of all runs of ``k`` words; of the whole sequence when it is shorter; nothing for no words."""
    if not len(w):
        return w
    k = min(k, len(w))
    return _runs(w, k)


def _runs(w: np.ndarray, k: int) -> np.ndarray:
    m = len(w) - k + 1
    with np.errstate(over="ignore"):
        out = w[:m] * (_STEP[0] + U64(2 * k))
        for i in range(1, k):
            out += w[i : m + i] * (_STEP[i % 5] + U64(2 * (i // 5)))
        return mix(out)


def document_words(column: pa.Array) -> Iterator[np.ndarray]:
    """Word hashes of each text in turn."""
    for h, _ in document_words_and_endings(column, False):
        yield h


_FOLD = np.arange(256, dtype=np.uint16)
_FOLD[ord("A") : ord("Z") + 1] += 32


def document_words_and_endings(column: pa.Array, endings: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Word hashes of each text in turn, and the last two bytes of each word, A-Z folded (the one before the last is 0 if there is none)."""
    raw, offsets = text_buffers(column)
    for i, j in chunks(offsets):
        own, off = raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        s, e, first = words(own, off)
        h, end = span_hashes(own, s, e), np.zeros(0, np.uint16)
        if endings and len(e):
            end = _FOLD[own[e - 1]] | np.where(e - s > 1, _FOLD[own[np.maximum(e - 2, 0)]] << np.uint16(8), np.uint16(0))
        for d in range(j - i):
            yield h[first[d] : first[d + 1]], end[first[d] : first[d + 1]]


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    if len(x) < 2:
        return x
    x = np.sort(x)
    keep = np.empty(len(x), bool)
    keep[0] = True
    np.not_equal(x[1:], x[:-1], out=keep[1:])
    return x[keep]


def document_shingles(column: pa.Array, k: int = 5) -> Iterator[np.ndarray]:
    """Each text's sorted distinct ``k``-word shingles (the whole sequence as one when it is shorter)."""
    raw, offsets = text_buffers(column)
    for i, j in chunks(offsets):
        own, off = raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        s, e, first = words(own, off)
        h = span_hashes(own, s, e)
        runs = _runs(h, k) if len(h) >= k else h[:0]
        for d in range(j - i):
            a, b = first[d], first[d + 1]
            yield distinct(runs[a : b - k + 1]) if b - a >= k else shingle_hashes(h[a:b], k)
