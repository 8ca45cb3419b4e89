"""A one-hash membership filter of bounded size, built by a Spark aggregate and broadcast.

It only saves work: a set bit is confirmed by an exact join afterwards, so false
positives cost time and never change a result. Its size follows the number of
keys (``PER_KEY`` bits each). Keys that would need more than 2**``MOST`` bits get no
filter: ``build`` returns None, which lets every key through to the join, as for
any table too large to broadcast.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandflow.llm import textkernels as K
from strandflow.llm.tables import fresh

PER_KEY = 16
#: Powers of two: the least and the most bits of a filter.
LEAST, MOST = 22, 28
_BUCKET = 32768  # bits in a bitmap of bitmap_construct_agg


def bits_for(keys: int) -> int:
    return max(LEAST, (max(keys, 1) * PER_KEY - 1).bit_length())


def slot(key: Column, bits: int) -> Column:
    """The bit of a key: the low bits of a 64-bit hash."""
    return key.bitwiseAND((1 << bits) - 1)


def build(keys: DataFrame, key: Column, bits: int | None = None) -> np.ndarray | None:
    """2**bits bits as bytes, at most 2**MOST / 8 bytes at the driver; None if the keys need more. ``key``: a 64-bit hash."""
    bits = bits_for(keys.count()) if bits is None else bits
    if bits > MOST:
        return None
    v = keys.select((slot(key, bits) + 1).alias("v")).select(F.bitmap_bucket_number("v").alias("b"), F.bitmap_bit_position("v").alias("p"))
    out = np.zeros(max(1, (1 << bits) // _BUCKET) * _BUCKET // 8, np.uint8)
    for row in v.repartition("b").groupBy("b").agg(F.bitmap_construct_agg("p").alias("m")).toLocalIterator():
        part = np.frombuffer(bytes(row["m"]), np.uint8)
        at = (row["b"] - 1) * _BUCKET // 8
        out[at : at + len(part)] = part
    return out


def test(table: np.ndarray | None, keys: np.ndarray) -> np.ndarray:
    """Is the bit of each 64-bit key set?"""
    if table is None:
        return np.ones(len(keys), bool)
    at = keys & np.uint64(len(table) * 8 - 1)
    return (table[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def _choose(shared, name: str, wanted: bool):
    @K.tidy
    def choose(batches):
        for batch in batches:
            key = batch.column(name)
            hit = test(shared.value, key.fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64))
            hit &= key.is_valid().to_numpy(zero_copy_only=False)
            yield batch.filter(pa.array(hit == wanted))

    return choose


def divide(rows: DataFrame, key: Column, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows whose key is null or for sure not in the one column of ``keys`` (of the key's type), and the rest; columns unchanged."""
    table = build(keys, F.xxhash64(keys.columns[0]))
    shared = rows.sparkSession.sparkContext.broadcast(table)
    (name,) = fresh(rows, "_key")
    hashed = rows.withColumn(name, F.when(key.isNotNull(), F.xxhash64(key)))
    return tuple(hashed.mapInArrow(_choose(shared, name, wanted), hashed.schema).drop(name) for wanted in (False, True))


def without(rows: DataFrame, key: Column, keys: DataFrame) -> DataFrame:
    """Anti-join that shuffles only the rows that the filter can't clear. ``keys``: one column, of the type of ``key``."""
    clear, rest = divide(rows, key, keys)
    (name,) = fresh(rows, "_gone")
    rest = rest.join(keys.toDF(name), key == F.col(name), "left_anti")
    return clear.unionByName(rest)
