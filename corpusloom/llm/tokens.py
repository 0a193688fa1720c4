"""Vectorised words, hashes and shingles over the UTF-8 buffers of Arrow batches.

Hashes are polynomial prefix sums modulo 2**64 over randomised byte codes, finished by a bit mixer, so
the hash of any substring costs one subtraction and one product, whatever its length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BASE = 0x9E3779B97F4A7C15 | 1
U64 = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240229))
CODES = _rng.integers(1, 2**63, 256, dtype=np.uint64) | U64(1)
CODES_LOWER = CODES.copy()
CODES_LOWER[65:91] = CODES[97:123]
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
_POW = np.ones(1, U64)
_INV = np.ones(1, U64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POW, _INV
    if len(_POW) < n:
        size = max(n, 1 << 16)

        def series(x: int) -> np.ndarray:
            out = np.full(size, x % 2**64, U64)
            out[0] = 1
            return np.cumprod(out, dtype=U64)

        _POW, _INV = series(BASE), series(pow(BASE, -1, 2**64))
    return _POW, _INV


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective bit mixer on uint64."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def prefix(values: np.ndarray) -> np.ndarray:
    """Prefix sums from which span() hashes substrings."""
    pw, _ = _powers(len(values) + 1)
    out = np.zeros(len(values) + 1, U64)
    np.cumsum(values * pw[: len(values)], out=out[1:])
    return out


def span(pre: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Position-independent hash of values[start:end]."""
    _, inv = _powers(len(pre))
    return mix((pre[end] - pre[start]) * inv[start])


class Chunk:
    """Some documents of a batch: buf holds their bytes, offs the n+1 boundaries, lo the first document's row."""

    __slots__ = ("buf", "offs", "lo", "n")

    def __init__(self, buf: np.ndarray, offs: np.ndarray, lo: int):
        self.buf, self.offs, self.lo, self.n = buf, offs, lo, len(offs) - 1

    def text(self, i: int) -> bytes:
        return self.buf[self.offs[i] : self.offs[i + 1]].tobytes()


def chunks(column: pa.Array, limit: int = 1 << 20) -> Iterator[Chunk]:
    """Splits a string column into runs of documents of about limit bytes (a longer document stands alone). Null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_binary())
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        hi = min(hi, n)
        yield Chunk(raw[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo], lo)
        lo = hi


def word_bounds(c: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of non-space bytes, and the n+1 word boundaries of the documents."""
    if not len(c.buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(c.n + 1, np.int64)
    inside = ~SPACE[c.buf]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cut = c.offs[1:-1]
    cut = cut[(cut > 0) & (cut < len(c.buf))]
    first[cut] = inside[cut]
    last[cut - 1] = inside[cut - 1]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, np.searchsorted(start, c.offs)


def words(c: Chunk, codes: np.ndarray = CODES) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends, document boundaries and 64-bit hashes of the words."""
    start, end, bound = word_bounds(c)
    return start, end, bound, span(prefix(codes[c.buf]), start, end)


def shingles(h: np.ndarray, bound: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k consecutive words within a document, and their documents.

    A document of 1 to k-1 words has one shingle: all of it; an empty one has none.
    """
    n = np.diff(bound)
    count = np.where(n >= k, n - k + 1, (n > 0).astype(n.dtype))
    doc = np.repeat(np.arange(len(n)), count)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count) + bound[:-1][doc]
    return span(prefix(h), at, np.minimum(at + k, bound[1:][doc])), doc
