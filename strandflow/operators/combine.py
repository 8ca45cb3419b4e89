"""Several inputs or outputs: tagged merge, dispatch by source, fan-out, positional alignment, keyed join."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandflow.operators.ordered import number

SOURCE = "_source"


def merge(*inputs: DataFrame) -> DataFrame:
    """UNION ALL; each row carries the index of its input. The same input twice comes twice, under two indexes."""
    tagged = [df.withColumn(SOURCE, F.lit(i)) for i, df in enumerate(inputs)]
    return reduce(lambda a, b: a.unionByName(b), tagged)


def merge_distinct(*inputs: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), inputs).distinct()


def merge_intersect(*inputs: DataFrame) -> DataFrame:
    """Rows that every input has, once each."""
    return reduce(lambda a, b: a.intersect(b.select(*a.columns)), inputs)


def merge_except(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Rows of the first input that no other has, once each."""
    return reduce(lambda a, b: a.subtract(b.select(*a.columns)), others, first)


def dispatch(*cases: Column) -> Column:
    """The i-th expression for rows of the i-th input."""
    out = F.when(F.col(SOURCE) == 0, cases[0])
    for i, case in enumerate(cases[1:], 1):
        out = out.when(F.col(SOURCE) == i, case)
    return out


def fan_out(df: DataFrame, *branches: Callable[[DataFrame], DataFrame]) -> list[DataFrame]:
    """Every branch sees every row; rows are immutable, so branches can't disturb each other."""
    return [branch(df) for branch in branches]


def align(left: DataFrame, right: DataFrame, order: str = "seq", other: str | None = None) -> DataFrame:
    """Pairs the i-th row of one input with the i-th of the other, as columns ``left`` and ``right`` (structs) by ``_pos``; surplus rows find no partner."""
    a, b = number(left, order), number(right, other or order)
    pack = lambda df, name: df.select("_pos", F.struct(*(c for c in df.columns if c != "_pos")).alias(name))
    return pack(a, "left").join(pack(b, "right"), "_pos")


def keyed_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Matches of two inputs by key; Spark picks the strategy and splits skewed keys."""
    return left.join(right, keys, how)
