"""Vectorised text primitives on the UTF-8 buffers of Arrow string columns.

Words are found and hashed for a whole chunk of documents with a handful of
numpy passes; no Python object is made for a word.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; a longer document is a chunk of its own.
CHUNK_BYTES = 1 << 20
#: The same where what is made of a text hangs on nothing beside it: numbers of 64 bits for every byte weigh less.
FINE_BYTES = 1 << 18

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

#: Bytes that make up words: ASCII letters and digits, and everything beyond ASCII.
WORD = np.zeros(256, bool)
WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse; a worker keeps no more than a chunk needs."""
    if len(_powers[0]) >= n:
        return _powers[0][:n], _powers[1][:n]
    made = []
    for b in (_BASE, _INVERSE):
        p = np.full(max(n, CHUNK_BYTES + 1), b, np.uint64)
        p[0] = 1
        made.append(np.multiply.accumulate(p))
    if n <= CHUNK_BYTES + 1:
        _powers[:] = made
    return made[0][:n], made[1][:n]


def sliced(batches: Iterable[pa.RecordBatch], name: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most ``limit`` bytes of text, or of one row: what is made of a text weighs many times as much."""
    for b in batches:
        size = pc.fill_null(pc.binary_length(b.column(name)), 0)
        off = np.r_[0, np.cumsum(size.to_numpy(zero_copy_only=False), dtype=np.int64)]
        for lo, hi in chunks(off, limit):
            yield b.slice(lo, hi - lo)
    release()


try:
    _trim = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError):  # another C library
    _trim = None


def release() -> None:
    """Give free memory back to the system: workers live on after a task, and several stages' peaks would add up."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def column(array: pa.Array | pa.ChunkedArray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null reads as empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    array = pc.fill_null(array.cast(pa.large_string()), "")
    if lower:
        array = pc.utf8_lower(array)
    n = len(array)
    _, off, data = array.buffers()
    offsets = np.frombuffer(off, np.int64)[array.offset : array.offset + n + 1] if n else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), offsets


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes, or of one row."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = hi


@dataclass
class Words:
    """The words of rows lo..hi: where each is in the chunk's bytes, its row and its hash."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    hash: np.ndarray


def words(data: np.ndarray, offsets: np.ndarray, lo: int, hi: int) -> Words:
    """Words (runs of letters, digits and non-ASCII bytes) of rows lo..hi."""
    base = offsets[lo]
    d, off = data[base : offsets[hi]], offsets[lo : hi + 1] - base
    inside = WORD[d]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edges = off[(off > 0) & (off < len(d))]
    first[edges] = inside[edges]
    last[edges - 1] = inside[edges - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return Words(d, start, end, np.searchsorted(off, start, "right") - 1 + lo, mix(_polynomials(d, start, end)))


def _polynomials(d: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The sum of (byte + 1) * base^i over every word, block by block; a word may reach over several."""
    h = np.zeros(len(start), np.uint64)
    for at in range(0, len(d), CHUNK_BYTES):
        block = d[at : at + CHUNK_BYTES]
        n = len(block)
        p, q = powers(n + 1)
        prefix = np.zeros(n + 1, np.uint64)
        np.cumsum((block.astype(np.uint64) + np.uint64(1)) * p[:n], out=prefix[1:])
        lo, hi = np.searchsorted(end, at, "right"), np.searchsorted(start, at + n)
        if lo == hi:
            continue
        a, z = np.maximum(start[lo:hi] - at, 0), np.minimum(end[lo:hi] - at, n)
        part = (prefix[z] - prefix[a]) * q[a]
        if start[lo] < at:
            part[:1] *= np.array([pow(_BASE, int(at - start[lo]), 1 << 64)], np.uint64)
        h[lo:hi] += part
    return h


_SHINGLE = [np.uint64(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]


def shingles(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every run of ``size`` words within a row; a row with fewer words is one shingle."""
    row, h = w.row, w.hash
    if not len(h):
        return h, row
    n = max(0, len(h) - size + 1)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out += h[k : k + n] * _SHINGLE[k % 5] * np.uint64(2 * k + 1)
    whole = row[:n] == row[size - 1 :] if n else np.zeros(0, bool)
    out, rows = mix(out[whole]), row[:n][whole]
    heads = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    counts = np.diff(np.r_[heads, len(row)])
    short = counts < size
    if short.any():
        at = heads[short]
        extra = np.zeros(len(at), np.uint64)
        for k in range(size - 1):
            has = counts[short] > k
            extra[has] += h[at[has] + k] * _SHINGLE[k % 5] * np.uint64(2 * k + 1)
        out, rows = np.r_[out, mix(extra + np.uint64(7))], np.r_[rows, row[at]]
        order = np.argsort(rows, kind="stable")
        out, rows = out[order], rows[order]
    return out, rows


def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first positions, lengths) of the runs of equal neighbours."""
    if not len(keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return first, np.diff(np.r_[first, len(keys)])
