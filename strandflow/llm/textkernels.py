"""Vectorised text kernels over Arrow string columns.

All kernels work on the UTF-8 bytes of a piece of an Arrow batch (at most
``PIECE`` bytes, or one document if that is longer), so that memory follows the
piece and not the table. Nulls count as empty texts.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property, wraps

import numpy as np
import pyarrow as pa

#: Bytes of text that a kernel looks at together; one longer document is a piece of its own.
PIECE = 1 << 20


def byte_table(kept) -> np.ndarray:
    """256 booleans: does a byte belong to a word?"""
    return np.array([bool(kept(b)) for b in range(256)])


#: ``[^\x20\x09-\x0D]+``: anything but ASCII blanks.
NON_BLANK = byte_table(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing A-Z.
ALNUM = byte_table(lambda b: b > 0x7F or chr(b).isalnum())
SAME = np.arange(256, dtype=np.uint8)
LOWER = np.where((SAME >= 65) & (SAME <= 90), SAME + 32, SAME).astype(np.uint8)

#: The bytes of a lane that belong to a word with so many bytes left.
_KEEP = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
#: Longer words are hashed one by one.
LONG = 256
_LIBC = ctypes.CDLL(None)


def give_back() -> None:
    """Hands freed memory back to the system, where the allocators can."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(_LIBC, "malloc_trim", None):
        trim(0)


def tidy(emit: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function of batches that ends with ``give_back``: Spark keeps a worker when its task is over, and what an idle one holds counts beside those that run."""

    @wraps(emit)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from emit(batches)
        finally:
            give_back()

    return run


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; keeps the number of distinct values."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xC2B2AE3D27D4EB4F)
    return h ^ (h >> np.uint64(32))


def fold(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One hash of two, in order; for a given ``a``, different ``b`` give different results. Not linear in either."""
    h = a * np.uint64(0x9E3779B97F4A7C15) + b
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def string_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and the offsets of its rows, nulls as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def pieces(column: pa.Array, most: int = PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of runs of rows of at most ``most`` bytes."""
    data, at = string_bytes(column)
    lo, n = 0, len(at) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + most, "right")) - 1)
        yield lo, hi, data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


@dataclass
class Words:
    """Words of a piece: byte ranges, and for each document the range of its words."""

    data: np.ndarray
    at: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    table: np.ndarray
    case: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def docs(self) -> np.ndarray:
        """The document of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts())

    @cached_property
    def bytes(self) -> np.ndarray:
        """The data after the case table."""
        return self.data if self.case is SAME else self.case[self.data]

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word (after the case table), equal for equal words in any piece: eight bytes at a time, folded."""
        return self._hashes

    @cached_property
    def _hashes(self) -> np.ndarray:
        size = self.ends - self.starts
        if not len(size):
            return np.zeros(0, np.uint64)
        padded = np.concatenate([self.bytes, np.zeros(8, np.uint8)])
        lanes = np.ndarray((len(self.data) + 1,), "<u8", padded, strides=(1,))
        out = fold(size.astype(np.uint64), lanes[self.starts] & _KEEP[np.minimum(size, 8)])
        rest, done = np.flatnonzero((size > 8) & (size <= LONG)), 8
        while len(rest):
            left = size[rest] - done
            out[rest] = fold(out[rest], lanes[self.starts[rest] + done] & _KEEP[np.minimum(left, 8)])
            rest, done = rest[left > 8], done + 8
        for i in np.flatnonzero(size > LONG).tolist():
            digest = hashlib.blake2b(padded[self.starts[i] : self.ends[i]], digest_size=8).digest()
            out[i] = int.from_bytes(digest, "little")
        return mix(out)

    def text(self, first: int, last: int) -> list[bytes]:
        """The words from ``first`` to before ``last``, after the case table."""
        raw = self.bytes[self.starts[first] : self.ends[last - 1]].tobytes() if last > first else b""
        shift = int(self.starts[first]) if last > first else 0
        return [raw[a - shift : b - shift] for a, b in zip(self.starts[first:last].tolist(), self.ends[first:last].tolist(), strict=True)]

    def prefixes(self, length: int) -> np.ndarray:
        """The first ``length`` bytes (at most 7) of each word as an integer."""
        out = np.zeros(len(self.starts), np.uint64)
        for j in range(length):
            here = self.starts + j
            inside = here < self.ends
            out |= np.where(inside, self.case[self.data[np.where(inside, here, 0)]], 0).astype(np.uint64) << np.uint64(8 * j)
        return out

    def suffixes(self, length: int) -> np.ndarray:
        """The last ``length`` bytes (at most 7) of each word as an integer, the last one lowest."""
        padded = np.concatenate([np.zeros(8, np.uint8), self.bytes])
        lanes = np.ndarray((len(self.data) + 1,), ">u8", padded, strides=(1,))
        return lanes[self.ends].astype(np.uint64) & _KEEP[np.minimum(self.ends - self.starts, length)]


def words(data: np.ndarray, at: np.ndarray, table: np.ndarray = NON_BLANK, case: np.ndarray = SAME) -> Words:
    inside = table[case[data]] if case is not SAME else table[data]
    n = len(inside)
    if not n:
        empty = np.zeros(0, np.int64)
        return Words(data, at, empty, empty, np.zeros(len(at), np.int64), table, case)
    start, end = inside.copy(), inside.copy()
    edges = at[1:-1]
    edges = edges[(edges > 0) & (edges < n)]
    start[1:] &= ~inside[:-1]
    start[edges] = inside[edges]
    end[:-1] &= ~inside[1:]
    end[edges - 1] = inside[edges - 1]
    starts = np.flatnonzero(start)
    return Words(data, at, starts, np.flatnonzero(end) + 1, np.searchsorted(starts, at), table, case)


def windows(hashes: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """Hash of each run of ``size`` consecutive word hashes, by folding runs of doubled length; runs that cross documents are not told apart."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, done, run, long = np.full(n, size + seed * 0x10001, np.uint64), 0, hashes, 1
    while True:
        if size & long:
            out, done = fold(out, run[done : done + n]), done + long
        if done == size:
            return mix(out)
        run, long = fold(run[:-long], run[long:]), 2 * long


def in_sorted(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Index of each value in a sorted table, -1 where it is absent."""
    if not len(table):
        return np.full(len(values), -1)
    at = np.searchsorted(table, values)
    at[at == len(table)] = 0
    return np.where(table[at] == values, at, -1)


def code_points_before(data: np.ndarray) -> np.ndarray:
    """Number of code points before each byte, one more entry than bytes."""
    return np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
