"""Vectorised text kernels on Arrow buffers.

Texts stay UTF-8 bytes in one buffer with offsets; words are found by byte classes and hashed from
prefix sums, so no Python object is made per word.  All hashes are 64-bit polynomials modulo 2**64
over a random byte table, mixed at the end; equal bytes always give equal hashes, on any executor.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_libc = ctypes.CDLL(None) if hasattr(ctypes.CDLL(None), "malloc_trim") else None
SLICE = 2 << 20  # bytes of text worked on at once; a longer document is a slice of its own
STEP = 1 << 18  # entries by which the tables of powers grow

_rng = np.random.Generator(np.random.PCG64(20240607))
CODES = _rng.integers(1, 2**63, 256, dtype=np.uint64) | U64(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
CODES_LOWER = CODES[LOWER]
COMBINE = _rng.integers(1, 2**63, 64, dtype=np.uint64) | U64(1)
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 2**64)
_pow = np.ones(1, np.uint64)
_inv = np.ones(1, np.uint64)

#: Byte classes: ASCII letters and digits and all non-ASCII; letters and all non-ASCII; not white space.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True
ALPHA = ALNUM.copy()
ALPHA[48:58] = False
NONSPACE = np.ones(256, bool)
NONSPACE[[9, 10, 11, 12, 13, 32]] = False


def release() -> None:
    global _pow, _inv
    _pow, _inv = np.ones(1, np.uint64), np.ones(1, np.uint64)  # made again in a few ms; idle workers keep none
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)


def tidy(work):
    """An Arrow function that hands freed memory back at its end: workers outlive many tasks of many kinds."""

    def run(batches):
        try:
            yield from work(batches)
        finally:
            release()

    return run


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U64(31))
    h = h * U64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U64(29))
    h = h * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(32))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pow, _inv
    if len(_pow) < n:
        size = -(-n // STEP) * STEP
        one = np.full(size, BASE, np.uint64)
        one[0] = 1
        _pow = np.cumprod(one, dtype=np.uint64)
        one[1:] = INVERSE
        _inv = np.cumprod(one, dtype=np.uint64)
    return _pow[:n], _inv[:n]


class Slice:
    """Some consecutive rows of a batch: first row, UTF-8 bytes and the rows' offsets in them."""

    def __init__(self, first: int, buf: np.ndarray, off: np.ndarray):
        self.first, self.buf, self.off = first, buf, off
        self.rows = len(off) - 1
        self._sums = None

    def sums(self, codes: np.ndarray = CODES_LOWER) -> np.ndarray:
        """Prefix sums for ``span_hash``; by default A-Z count as a-z."""
        if self._sums is None:
            out = np.zeros(len(self.buf) + 1, np.uint64)
            np.cumsum(codes[self.buf] * powers(len(self.buf))[0], out=out[1:])
            self._sums = out
        return self._sums

    def span_hash(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        s = self.sums()
        return mix((s[hi] - s[lo]) * powers(len(s))[1][lo] + (hi - lo).astype(np.uint64) * COMBINE[63])

    def words(self, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and the offsets of each row in them; words never cross rows."""
        inside = kind[self.buf]
        begin, end = inside.copy(), inside.copy()
        begin[1:] &= ~inside[:-1]
        end[:-1] &= ~inside[1:]
        some = self.off[1:] > self.off[:-1]
        lo, hi = self.off[:-1][some], self.off[1:][some] - 1
        begin[lo] = inside[lo]
        end[hi] = inside[hi]
        ws = np.flatnonzero(begin)
        return ws, np.flatnonzero(end) + 1, np.searchsorted(ws, self.off)

    def text(self, row: int) -> bytes:
        return self.buf[self.off[row] : self.off[row + 1]].tobytes()


def slices(col: pa.Array, size: int = SLICE) -> Iterator[Slice]:
    """Cut a string column into slices of about ``size`` bytes; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if pa.types.is_null(col.type):
        col = col.cast(pa.string())
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offsets, data = col.buffers()
    if len(col) == 0:
        return
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(col):
        to = max(at + 1, int(np.searchsorted(off, off[at] + size, "right")) - 1)
        yield Slice(at, buf[off[at] : off[to]], off[at : to + 1] - off[at])
        at = to


def ngrams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n consecutive entries of h (n may exceed no constant table: powers repeat mixed)."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(h) - n + 1, np.uint64)
    for j in range(n):
        out += h[j : j + len(out)] * COMBINE[j]
    return mix(out)


def row_of(offsets: np.ndarray) -> np.ndarray:
    """The row of each entry, from the rows' offsets."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def sliding_min(h: np.ndarray, w: int) -> np.ndarray:
    """Least of each w consecutive entries."""
    span, out = 1, h
    while span * 2 <= w:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    return np.minimum(out[: len(h) - w + 1], out[w - span : w - span + len(h) - w + 1])


def ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Indices start[0]..start[0]+size[0]-1, start[1]..., concatenated."""
    total = int(size.sum())
    at = np.cumsum(size) - size
    return np.repeat(start - at, size) + np.arange(total)
