"""Map, flat-map, filter and pass-through, as projections that Catalyst can push around."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def map_values(df: DataFrame, **columns: Column) -> DataFrame:
    """One row for each row: only the named columns come out (a new value carries no key, source or time)."""
    return df.select(*(c.alias(name) for name, c in columns.items()))


def flat_map(df: DataFrame, values: Column, name: str = "value", keep: tuple[str, ...] = (), place: str | None = None) -> DataFrame:
    """A row for each entry of an array column, in order; ``place`` names a column for the entry's position."""
    if place:
        return df.select(*keep, F.posexplode(values).alias(place, name))
    return df.select(*keep, F.explode(values).alias(name))


def keep(df: DataFrame, condition: Column) -> DataFrame:
    return df.where(condition)


def pass_through(df: DataFrame) -> DataFrame:
    """The same rows with all their decorations."""
    return df


def apply_function(df: DataFrame, function: Callable, schema: str) -> DataFrame:
    """An opaque function over Arrow batches, for what columns can't express; it blocks push-down."""
    return df.mapInArrow(function, schema)
