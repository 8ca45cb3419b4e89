"""Running aggregates in arrival order that don't depend on a key to spread.

A running aggregate over everything, or over a handful of keys, is one task in a
plain window. Here order is cut into ranges at quantiles: range totals are
folded over the ranges (few rows), and the fold of all earlier ranges goes
before a range's rows as a row of its own. One shuffle and one sort of the rows,
by key and range, and no join.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_FOLDS = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}


@dataclass(frozen=True)
class EvenCuts:
    """Ranges of positions 0 to ``rows`` - 1, by arithmetic."""

    rows: int
    ranges: int

    def place(self, order: Column) -> Column:
        at = F.floor(order.cast("double") * self.ranges / max(self.rows, 1))
        return F.coalesce(F.least(F.greatest(at, F.lit(0)), F.lit(self.ranges - 1)), F.lit(0)).cast("int")


@dataclass(frozen=True)
class Cuts:
    """Ranges between ascending values, by binary search."""

    values: tuple[float, ...]

    def place(self, order: Column) -> Column:
        """How many values ``order`` has reached."""
        if not self.values:
            return F.lit(0)
        bits = len(self.values).bit_length()
        table = F.array(*(F.lit(float(c)) for c in [*self.values, *[float("inf")] * ((1 << bits) - len(self.values))]))
        steps = F.array(*(F.lit(1 << i) for i in reversed(range(bits))))
        value = order.cast("double")
        return F.coalesce(F.aggregate(steps, F.lit(0), lambda at, step: at + F.when(F.element_at(table, at + step) <= value, step).otherwise(0)), F.lit(0))


def ranges_of(spark: SparkSession) -> int:
    """As many ranges as a shuffle has partitions, whatever the rows."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def even_cuts(spark: SparkSession, rows: int) -> EvenCuts:
    """Cuts for positions 0 to ``rows`` - 1."""
    return EvenCuts(rows, ranges_of(spark))


def quantile_cuts(df: DataFrame, order: str) -> Cuts:
    """Cuts at approximate quantiles of a numeric column. Any cuts give the same results; these spread evenly.

    Costs a pass over the column; take them from a table near the source and hand
    them on where the order stays the same.
    """
    n = ranges_of(df.sparkSession)
    found = df.approxQuantile(order, [i / n for i in range(1, n)], 0.25 / n) if n > 1 else []
    return Cuts(tuple(sorted({c for c in found if c is not None})))


def running(df: DataFrame, order: str, folds: dict[str, tuple[str, Column]], keys: tuple[str, ...] = (), ties: tuple[str, ...] = (), cuts: Cuts | EvenCuts | None = None) -> DataFrame:
    """Adds a column for each fold: ``{name: (sum | count | min | max, column)}`` from the first row up to this one.

    ``order`` is a numeric column; rows of equal ``order`` come by ``ties``, null
    order comes first. Null keys are a key. Nulls in folded columns are passed
    over. ``cuts``: where to cut the order, by default at its quantiles. Without
    keys, the totals of the ranges are computed at once.
    """
    cuts = quantile_cuts(df, order) if cuts is None else cuts
    mark = "_"
    while any(c.lower().startswith((f"{mark}range", f"{mark}own", f"{mark}v")) for c in df.columns):
        mark += "_"
    place, own, values = f"{mark}range", f"{mark}own", [f"{mark}v{i}" for i in range(len(folds))]
    # a count is a sum of ones and zeros, so that what is carried is a value like any other
    parts = {v: F.when(column.isNull(), 0).otherwise(1).cast("long") if kind == "count" else column for v, (kind, column) in zip(values, folds.values())}
    fold = {v: _FOLDS["sum" if kind == "count" else kind](v) for v, (kind, _) in zip(values, folds.values())}
    rows = df.withColumns({**parts, place: cuts.place(F.col(order)), own: F.lit(True)})
    totals = rows.groupBy(*keys, place).agg(*(fold[v].alias(v) for v in values))
    types = totals.schema
    if not keys:  # one row a range: taken now, so that what comes before the fold is not computed twice wherever the result is used
        totals = df.sparkSession.createDataFrame(totals.toArrow(), types)
    before = Window.partitionBy(*keys).orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(*keys, place, *(fold[v].over(before).alias(v) for v in values), F.lit(False).alias(own))
    so_far = Window.partitionBy(*keys, place).orderBy(own, order, *ties).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = {name: fold[v].over(so_far).cast(types[v].dataType) for name, v in zip(folds, values)}
    return rows.unionByName(carried, allowMissingColumns=True).withColumns(found).where(F.col(own)).drop(*values, place, own)


def number(df: DataFrame, order: str, name: str = "_pos", keys: tuple[str, ...] = (), ties: tuple[str, ...] = (), cuts: Cuts | EvenCuts | None = None) -> DataFrame:
    """Adds the position of each row in arrival order, from 0."""
    return running(df, order, {name: ("count", F.lit(1))}, keys, ties, cuts).withColumn(name, F.col(name) - 1)
