"""Vectorised byte kernels for Arrow batches: word boundaries and word, shingle and span hashes.

All take one buffer of concatenated UTF-8 texts with row offsets. Hashes are polynomial prefix sums mod 2^64
finished by a mixer, so a span of any length costs the same. Batches are cut into slices of bounded
bytes (a single longer text is a slice of its own).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U64 = np.uint64
_P = 0x9E3779B97F4A7C15 | 1
_PINV = pow(_P, -1, 1 << 64)
#: Text bytes that are worked on at once.
SLICE_BYTES = 2 << 20


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: every input bit moves every output bit."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) mod 2^64, by doubling."""
    out = np.ones(max(n, 1), U64)
    filled = 1
    while filled < n:
        step = U64(pow(base, filled, 1 << 64))
        take = min(filled, n - filled)
        out[filled : filled + take] = out[:take] * step
        filled += take
    return out


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets (one more than rows) of a string column; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if column.offset or len(column.buffers()[1]) // 8 < len(column) + 1:
        column = pa.concat_arrays([column])
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES):
    """Row ranges whose texts hold at most so many bytes, one row at least."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lo, hi
        lo = hi


_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_NOT_ALNUM = np.zeros(256, bool)
_NOT_ALNUM[[*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Words:
    """The words of a slice of rows: start and end bytes, the row of each, and first word of each row."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, alnum: bool):
        if alnum:
            data = _LOWER[data]
        self.data, self.offsets, n = data, offsets, len(data)
        gap = (_NOT_ALNUM if alnum else _BLANK)[data]
        inside = np.zeros(n + 2, bool)
        inside[1:-1] = ~gap
        begins, ends = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
        edges = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < n)]
        begins[edges] |= ~gap[edges]
        ends[edges - 1] |= ~gap[edges - 1]
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.count = np.diff(self.first)
        self.row = np.repeat(np.arange(len(offsets) - 1), self.count)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        n = len(self.data)
        sums = np.zeros(n + 1, U64)
        np.cumsum((self.data.astype(U64) + U64(1)) * powers(_P, n), out=sums[1:])
        return mix64((sums[self.end] - sums[self.start]) * powers(_PINV, n)[self.start]) if n else np.zeros(0, U64)


def gram_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """The hash of ``size`` consecutive word hashes from each place on (to the places where they end inside)."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, U64)
    sums = np.zeros(len(hashes) + 1, U64)
    np.cumsum(hashes * powers(_P, len(hashes)), out=sums[1:])
    return mix64((sums[size:] - sums[:-size]) * powers(_PINV, n))


def within(words: Words, size: int) -> np.ndarray:
    """The places from which ``size`` words lie in one row."""
    n = len(words.row) - size + 1
    return np.flatnonzero(words.row[:n] == words.row[size - 1 :]) if n > 0 else np.zeros(0, np.int64)
