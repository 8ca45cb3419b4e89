"""Structured Streaming versions of keyed state, exact windows and positional alignment.

``transformWithStateInPandas`` holds the state in RocksDB, so it survives lost
executors and restarts from the query's checkpoint. Rows are taken in order of
``seq`` within a micro-batch; across batches, order of arrival is order of batch.
"""

from __future__ import annotations

import copy
import pickle
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """Stateful processors need this store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


def _sorted(parts: Iterator[pd.DataFrame], order: str) -> pd.DataFrame:
    frames = list(parts)
    return pd.concat(frames).sort_values(order, kind="stable") if frames else pd.DataFrame()


class RunningCount(StatefulProcessor):
    """After each row of a key, the number of its rows so far."""

    def __init__(self, columns: list[str], order: str):
        self.columns, self.order = columns, order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.count = handle.getValueState("count", "n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frame = _sorted(rows, self.order)
        n = self.count.get()[0] if self.count.exists() else 0
        frame["n"] = range(n + 1, n + 1 + len(frame))
        self.count.update((n + len(frame),))
        yield frame[[*self.columns, "n"]]


def _plain(df: DataFrame) -> tuple[DataFrame, dict[str, str], str]:
    """Columns under plain names (processors can't see names with leading underscores), the new name of each, and their schema."""
    name = {c: f"c{i}" for i, c in enumerate(df.columns)}
    return df.toDF(*name.values()), name, ", ".join(f"{name[f.name]} {f.dataType.simpleString()}" for f in df.schema)


def running_count(df: DataFrame, key: str, order: str = "seq") -> DataFrame:
    plain, name, schema = _plain(df)
    out = plain.groupBy(name[key]).transformWithStateInPandas(RunningCount(plain.columns, name[order]), schema + ", n long", "Append", "None")
    return out.toDF(*df.columns, "n")


class Fold(StatefulProcessor):
    """A user's step over each key's rows in order; its state lies pickled in the store."""

    def __init__(self, columns: dict[str, str], order: str, start, step: Callable, names: list[str]):
        self.columns, self.order, self.start, self.step, self.names = columns, order, start, step, names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "blob binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        state, out = pickle.loads(bytes(self.state.get()[0])) if self.state.exists() else copy.deepcopy(self.start), []
        for row in _sorted(rows, self.order).rename(columns=self.columns).to_dict("records"):
            state, found = self.step(state, row)
            out += found
        self.state.update((pickle.dumps(state),))
        yield pd.DataFrame(out, columns=self.names)


def fold(df: DataFrame, key: str, start, step: Callable, schema: str, order: str = "seq") -> DataFrame:
    """The streaming form of ``fold_opaque``: ``step(state, row) -> (state, rows)``; the state is kept from batch to batch."""
    plain, name, _ = _plain(df)
    kind = T.StructType.fromDDL(schema)
    names = [f"o{i}" for i in range(len(kind))]
    processor = Fold({v: k for k, v in name.items()}, name[order], start, step, names)
    out = T.StructType([T.StructField(n, f.dataType) for n, f in zip(names, kind, strict=True)])
    return plain.groupBy(name[key]).transformWithStateInPandas(processor, out, "Append", "None").toDF(*kind.names)


class RunningWatermark(StatefulProcessor):
    """The least, over the sources seen so far, of their running maximum watermark."""

    def __init__(self, columns: list[str], order: str, clock: str, source: str | None):
        self.columns, self.order, self.clock, self.source = columns, order, clock, source

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "source string", "wm long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frame = _sorted(rows, self.order)
        seen = {k[0]: v[0] for k, v in self.seen.iterator()}
        clock = []
        sources = frame[self.source].astype(str) if self.source else ["" for _ in range(len(frame))]
        for s, wm in zip(sources, frame[self.clock], strict=True):
            seen[s] = max(seen.get(s, wm), wm)
            clock.append(min(seen.values()))
        for s, wm in seen.items():
            self.seen.updateValue((s,), (int(wm),))
        frame[self.clock] = clock
        yield frame[self.columns]


def running_watermark(df: DataFrame, order: str = "seq", source: str | None = None) -> DataFrame:
    """Operator-wide watermark: one state, and so one task, as all inputs meet in it."""
    plain, name, schema = _plain(df)
    processor = RunningWatermark(plain.columns, name[order], name["_wm"], name[source] if source else None)
    return plain.withColumn("everything", F.lit(0)).groupBy("everything").transformWithStateInPandas(processor, schema, "Append", "None").toDF(*df.columns)


def count_and_sum(held: tuple, value: float) -> tuple:
    return held[0] + 1, held[1] + value


class Panes(StatefulProcessor):
    """Windows of one key: each row is folded into its windows, then those that the key's clock has passed fire."""

    def __init__(self, size: int, slide: int, start, add: Callable, finish: Callable, names: list[str]):
        self.size, self.slide, self.start, self.add, self.finish, self.names = size, slide, start, add, finish, names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.clock = handle.getValueState("clock", "wm long")
        self.open = handle.getMapState("open", "start long", "blob binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        clock = self.clock.get()[0] if self.clock.exists() else None
        held = {k[0]: pickle.loads(bytes(v[0])) for k, v in self.open.iterator()}
        before, out = set(held), []
        for row in _sorted(rows, "seq").itertuples():
            ts, wm = int(row.ts), int(row.wm)
            start = ts // self.slide * self.slide
            while ts >= 0 and start >= 0 and start + self.size > ts:
                held[start] = self.add(held[start] if start in held else copy.deepcopy(self.start), row.value)
                start -= self.slide
            clock = wm if clock is None else max(clock, wm)
            for start in sorted(s for s in held if s + self.size <= clock):
                out.append((key[0], start, start + self.size, int(row.seq), *self.finish(held.pop(start))))
        for start in before - set(held):
            self.open.removeKey((start,))
        for start, state in held.items():
            self.open.updateValue((start,), (pickle.dumps(state),))
        if clock is not None:
            self.clock.update((clock,))
        yield pd.DataFrame(out, columns=["k", "start", "stop", "pane", *self.names])


def fire(
    df: DataFrame, key: str, size: int, slide: int, value: Column | None = None, order: str = "seq",
    start=(0, 0.0), add: Callable = count_and_sum, finish: Callable = tuple, schema: str = "n long, total double",
) -> DataFrame:
    """Exact windows on a stream with ``_ts`` and an operator-wide ``_wm``: the panes of the batch operator.

    By default they hold the count and the sum of ``value``. Another fold: ``start``, ``add(held, value)``
    and ``finish(held)``, which gives the columns of ``schema``; what is held lies pickled in the store.
    """
    if size <= 0 or slide <= 0:
        raise ValueError("window size and slide must be positive")
    kind = df.schema[key].dataType.simpleString()
    value = F.lit(0.0) if value is None else value.cast("double") if add is count_and_sum else value
    rows = df.select(F.col(key).alias("k"), F.col(order).alias("seq"), F.col("_ts").alias("ts"), F.col("_wm").alias("wm"), value.alias("value"))
    names = T.StructType.fromDDL(schema).names
    out = rows.groupBy("k").transformWithStateInPandas(Panes(size, slide, start, add, finish, names), f"k {kind}, start long, stop long, pane long, {schema}", "Append", "None")
    return out.withColumnRenamed("k", key)


def native_windows(df: DataFrame, time: str, delay: str, size: str, slide: str | None, *keys: str, **folds: Column) -> DataFrame:
    """Spark's own event-time windows. They differ from ``fire``: late rows are dropped, the clock moves by micro-batch and for all keys at once, and ``slide`` is at most ``size``."""
    window = F.window(time, size, slide) if slide else F.window(time, size)
    return df.withWatermark(time, delay).groupBy(*keys, window.alias("window")).agg(*(c.alias(n) for n, c in folds.items()))


class Align(StatefulProcessor):
    """Two first-in-first-out buffers; pairs come out as soon as both have a row."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.left = handle.getListState("left", "value string")
        self.right = handle.getListState("right", "value string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frame = _sorted(rows, "seq")
        sides = [[v[0] for v in s.get()] if s.exists() else [] for s in (self.left, self.right)]
        for source, value in zip(frame["side"], frame["value"], strict=True):
            sides[int(source)].append(value)
        n = min(map(len, sides))
        for state, values in zip((self.left, self.right), sides, strict=True):
            state.clear()
            if values[n:]:
                state.put([(v,) for v in values[n:]])
        yield pd.DataFrame({"left": sides[0][:n], "right": sides[1][:n]}, dtype=object)


def align(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs the i-th ``value`` (string) of one stream with the i-th of the other; both have ``seq``. Order is global, so this is one state."""
    both = left.select("seq", "value", F.lit(0).alias("side")).unionByName(right.select("seq", "value", F.lit(1).alias("side")))
    return both.withColumn("everything", F.lit(0)).groupBy("everything").transformWithStateInPandas(Align(), "left string, right string", "Append", "None")
