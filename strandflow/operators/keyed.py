"""Keys, partition numbers, and per-key state."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandflow.functions import fnv1a64
from strandflow.operators.ordered import Cuts, EvenCuts, number, running


def key_by(df: DataFrame, key: Column, name: str = "key") -> DataFrame:
    """Stamps each row with its key: any expression; ``F.lit(0)`` sends all rows to one key."""
    return df.withColumn(name, key)


def partition_of(key: Column, parts: int, hashed: bool = False) -> Column:
    """Partition number of a key: the key itself, or the FNV-1a hash of a string key, modulo ``parts``."""
    return F.pmod(fnv1a64(key) if hashed else key, F.lit(parts)).cast("int")


def with_partition(df: DataFrame, key: Column, parts: int, hashed: bool = False) -> DataFrame:
    return df.withColumn("_partition", partition_of(key, parts, hashed))


def round_robin(df: DataFrame, parts: int, order: str = "seq") -> DataFrame:
    """The default key: arrival position modulo ``parts``."""
    return number(df, order).withColumn("_partition", (F.col("_pos") % parts).cast("int")).drop("_pos")


def running_fold(df: DataFrame, folds: dict[str, tuple[str, Column]], keys: tuple[str, ...] = (), order: str = "seq", cuts: Cuts | EvenCuts | None = None) -> DataFrame:
    """State after each row, for folds that Spark knows; hot keys are spread."""
    return running(df, order, folds, keys, cuts=cuts)


def final_fold(df: DataFrame, keys: tuple[str, ...], **folds: Column) -> DataFrame:
    """The last state of each key."""
    return df.groupBy(*keys).agg(*(c.alias(name) for name, c in folds.items()))


def dedupe_first(df: DataFrame, keys: tuple[str, ...], order: str = "seq") -> DataFrame:
    """The first row of each key: a minimum that is combined before the shuffle."""
    others = [c for c in df.columns if c not in keys]
    first = df.groupBy(*keys).agg(F.min_by(F.struct(*others), order).alias("_first"))
    return first.select(*keys, *(F.col("_first")[c].alias(c) for c in others)).select(*df.columns)


def fold_opaque(df: DataFrame, keys: tuple[str, ...], start, step: Callable, schema: str, order: str = "seq") -> DataFrame:
    """State that only Python can fold: ``step(state, row) -> (state, rows)`` over each key's rows in order.

    A key's rows must fit in memory; prefer ``running_fold`` where a fold is known.
    """

    def fold(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        import copy

        state, out = copy.deepcopy(start), []
        for row in rows.sort_values(order).to_dict("records"):
            state, found = step(state, row)
            out += found
        return pd.DataFrame(out, columns=[f.split()[0] for f in schema.split(",")])

    return df.groupBy(*keys).applyInPandas(fold, schema)


def salted_fold(df: DataFrame, keys: tuple[str, ...], salts: int, partial: dict[str, Column], final: dict[str, Column]) -> DataFrame:
    """Two-stage fold for folds without partial aggregation: ``salts`` groups a key first. Rows are dealt by their place, so that repeated rows part as well."""
    first = df.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts))).groupBy(*keys, "_salt").agg(*(c.alias(n) for n, c in partial.items()))
    return first.groupBy(*keys).agg(*(c.alias(n) for n, c in final.items()))


def ordered_list(value: Column, order: Column) -> Column:
    """A key's values in arrival order, as an aggregate; as long as the key's rows."""
    return F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), value.alias("v")))), lambda x: x["v"])


def first_rows(df: DataFrame, keys: tuple[str, ...], n: int, order: str = "seq") -> DataFrame:
    """The first ``n`` rows of each key; Spark cuts groups to n before it shuffles."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return df.withColumn("_n", place).where(F.col("_n") <= n).drop("_n")
