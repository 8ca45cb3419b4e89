"""Sinks: a typed log, a discarding sink, side effects by partition, and their streaming forms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming.query import StreamingQuery


def log(df: DataFrame, kind: str, column: str = "value", order: str | None = "seq") -> list:
    """The values of a small result, in arrival order if there is one; another type than ``kind`` fails before anything runs."""
    found = df.schema[column].dataType.simpleString()
    if found != kind:
        raise TypeError(f"the log takes {kind}, the stream has {found}")
    rows = df.orderBy(order) if order and order in df.columns else df
    return [r[column] for r in rows.select(column).toLocalIterator()]


def discard(df: DataFrame) -> None:
    """Runs the whole plan and drops its rows."""
    df.write.format("noop").mode("overwrite").save()


def each_partition(df: DataFrame, function: Callable) -> None:
    """Side effects over iterators of rows; they may run again when a task is retried."""
    df.foreachPartition(function)


def stream_log(df: DataFrame, name: str, checkpoint: str | None = None) -> StreamingQuery:
    """Appends a stream to the in-memory table ``name`` until its input is read."""
    writer = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True)
    return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()


def stream_batches(df: DataFrame, function: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Hands each micro-batch and its number to ``function``; with idempotent writes by number this is exactly-once."""
    return df.writeStream.foreachBatch(function).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
