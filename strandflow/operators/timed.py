"""Event time: per-row timestamps and watermarks, and windows that fire by key.

Unlike Spark's own event-time windows, a window fires when a row of its own key
arrives under a watermark that has passed it; a late row makes a pane of its
own; and what has not fired by the end of input is not emitted. All of it is
declarative:

* the clock of a key is the running maximum of watermarks over its rows, so the
  first row whose clock has reached a stop is the first whose own watermark has;
* a window's closing row is that row, found as a running minimum of arrival
  positions over rows and stops ordered by falling time;
* a row's pane is the later of itself and the closing row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandflow.functions import window_starts
from strandflow.operators.ordered import Cuts, EvenCuts, running

TS, WM = "_ts", "_wm"


def assign_time(df: DataFrame, ts: Column, wm: Column) -> DataFrame:
    """Both are the user's to compute, for each row; a fixed delay is ``ts - delay``."""
    return df.withColumns({TS: ts.cast("long"), WM: wm.cast("long")})


def watermark(df: DataFrame, order: str = "seq", cuts: Cuts | EvenCuts | None = None) -> DataFrame:
    """One input: the outgoing watermark is the running maximum of incoming ones."""
    return running(df, order, {WM: ("max", F.col(WM))}, cuts=cuts)


def merged_watermark(df: DataFrame, source: str, sources: list, order: str = "seq", cuts: Cuts | EvenCuts | None = None) -> DataFrame:
    """Several inputs: the least of the running maxima of those seen so far; an unseen input holds nothing back."""
    parts = {f"_wm{i}": ("max", F.when(F.col(source).eqNullSafe(F.lit(s)), F.col(WM))) for i, s in enumerate(sources)}
    out = running(df, order, parts, cuts=cuts)
    clock = F.least(*parts) if len(parts) > 1 else F.col("_wm0")
    return out.withColumn(WM, clock).drop(*parts)


def windows_of(df: DataFrame, size: int, slide: int, ts: str = TS, starts: Column | None = None) -> DataFrame:
    """A row for each window that holds the row: columns ``start`` and ``stop``. Tumbling, sliding or gapped.

    ``starts``: another assigner, an array column of the starts of the row's windows.
    """
    return df.withColumn("start", F.explode(window_starts(F.col(ts), size, slide) if starts is None else starts)).withColumn("stop", F.col("start") + size)


def panes(df: DataFrame, keys: tuple[str, ...], size: int, slide: int, order: str = "seq", cuts: Cuts | EvenCuts | None = None, time_cuts: Cuts | None = None, starts: Column | None = None) -> DataFrame:
    """A row for each row and window that fires: ``start``, ``stop``, and ``pane``, the arrival position at which it fires.

    A row without timestamp or watermark is an error, as its windows would be unknown.
    ``cuts`` and ``time_cuts`` say where arrival order and time may be cut for folding;
    ``starts`` is another assigner, an array column of the starts of the row's windows.
    """
    missing = F.when(F.col(TS).isNull() | F.col(WM).isNull(), F.raise_error("a row has no timestamp")).otherwise(F.col(TS))
    timed = df.withColumn(TS, missing.cast("long"))
    assigned = windows_of(timed, size, slide, starts=starts)
    # falling time; of equal times, rows come before stops, since a watermark equal to the stop closes it
    rows = timed.select(*keys, (F.lit(-2) * F.col(WM)).alias("_o"), F.col(order).alias("_row"), F.lit(None).cast("long").alias("_start"))
    stops = assigned.select(*keys, "start", "stop").distinct().select(*keys, (F.lit(-2) * F.col("stop") + 1).alias("_o"), F.lit(None).cast("long").alias("_row"), F.col("start").alias("_start"))
    falling = None if time_cuts is None else Cuts(tuple(sorted(-2 * c for c in time_cuts.values)))
    closing = running(rows.unionByName(stops), "_o", {"_closed": ("min", F.col("_row"))}, keys, cuts=falling).where("_start is not null and _closed is not null")
    closing = closing.select(*(F.col(k).alias(f"_c{i}") for i, k in enumerate(keys)), F.col("_start").alias("_cs"), "_closed")
    same = F.col("start") == F.col("_cs")
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"_c{i}"))
    out = assigned.join(closing, same).withColumn("pane", F.greatest(F.col(order), F.col("_closed")))
    return out.drop(*(f"_c{i}" for i in range(len(keys))), "_cs", "_closed")


def fire(df: DataFrame, keys: tuple[str, ...], size: int, slide: int, order: str = "seq", cuts: Cuts | EvenCuts | None = None, time_cuts: Cuts | None = None, starts: Column | None = None, **folds: Column) -> DataFrame:
    """The fired panes: keys, start, stop, pane, and the folds of their rows."""
    return panes(df, keys, size, slide, order, cuts, time_cuts, starts).groupBy(*keys, "start", "stop", "pane").agg(*(c.alias(n) for n, c in folds.items()))


def fire_each(df: DataFrame, keys: tuple[str, ...], size: int, slide: int, order: str = "seq", cuts: Cuts | EvenCuts | None = None, time_cuts: Cuts | None = None, starts: Column | None = None, **folds: tuple[str, Column]) -> DataFrame:
    """Early results: the folds of a pane after each of its rows."""
    return running(panes(df, keys, size, slide, order, cuts, time_cuts, starts), order, folds, (*keys, "start", "pane"), cuts=cuts)
