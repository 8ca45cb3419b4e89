"""Column functions: key hashes, time conversion, window labels, byte lengths."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the public 64-bit FNV-1a hash.
FNV_OFFSET = 14695981039346656037
FNV_PRIME = 1099511628211


def fnv1a64_of(values: pd.Series) -> pd.Series:
    """Unsigned hash of each string's UTF-8 bytes, as decimal text; null stays null. All strings advance byte by byte together."""
    raw = [v.encode() if v is not None else b"" for v in values]
    h = np.full(len(raw), FNV_OFFSET, np.uint64)
    length = np.array([len(r) for r in raw])
    order = np.argsort(-length, kind="stable")
    data = np.frombuffer(b"".join(raw), np.uint8)
    start = np.concatenate([[0], np.cumsum(length)])[:-1][order].astype(np.int64)
    left = length[order]
    out = h[order]
    for j in range(int(left[0]) if len(left) else 0):
        n = int(np.searchsorted(-left, -j, "left"))
        out[:n] = (out[:n] ^ data[start[:n] + j]) * np.uint64(FNV_PRIME)
    h[order] = out
    return pd.Series([None if v is None else str(x) for v, x in zip(values, h.tolist(), strict=True)], dtype=object)


def _fnv_batches(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for values in parts:
        yield fnv1a64_of(values)


def fnv1a64(value: Column) -> Column:
    """FNV-1a 64 of a string column as decimal(20,0), computed on Arrow batches."""
    return F.pandas_udf(_fnv_batches, "string")(value).cast("decimal(20,0)")


def byte_length(value: Column) -> Column:
    return F.octet_length(value)


def timestamp_of_nanos(nanos: Column) -> Column:
    """Timestamp of nanoseconds since the epoch; digits below a microsecond are cut (towards the past)."""
    return F.timestamp_micros(_floor_div(nanos, 1000))


def _floor_div(a: Column, b: int) -> Column:
    """Integer floor division, exact for longs."""
    return F.call_function("div", a - F.pmod(a, F.lit(b)), F.lit(b))


def nanos_of_timestamp(ts: Column) -> Column:
    return F.unix_micros(ts) * 1000


def window_label(start: Column, stop: Column) -> Column:
    """``[start, stop)``."""
    return F.format_string("[%d, %d)", start, stop)


def window_starts(ts: Column, size: int, slide: int) -> Column:
    """Starts of the windows that hold ``ts``, ascending: multiples of ``slide``, not below 0, with start <= ts < start + size."""
    if size <= 0 or slide <= 0:
        raise ValueError("window size and slide must be positive")
    last = _floor_div(ts, slide) * slide
    steps = -(-size // slide)
    candidates = F.transform(F.sequence(F.lit(steps - 1).cast("long"), F.lit(0).cast("long")), lambda i: last - i * slide)
    inside = F.filter(candidates, lambda s: (s >= 0) & (ts < s + size))
    return F.when(ts >= 0, inside).otherwise(F.array().cast("array<bigint>"))
