"""Running counts of the parts of texts: flat map and keyed count in one, on Arrow batches.

A row for each part before it is counted costs more than the count: rows are
shuffled, sorted and folded one by one. Here texts travel, one shuffle of them
by ranges of their order; a task splits the texts of a range in order and counts
on from what earlier ranges hold of each part. Parts become rows when they
are counted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandflow.operators.ordered import Cuts, quantile_cuts

#: Bytes of text that are split at once (a longer text alone), and parts that are counted at once.
PIECE, PARTS = 1 << 22, 1 << 20
LAST = (1 << 63) - 1


def _cut(batch: pa.RecordBatch, ends: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Pieces of about ``PIECE`` bytes of text that end before one of the rows ``ends`` (ascending; the last is the number of rows)."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch["text"]), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 8)
    start = 0
    while start < batch.num_rows:
        room = (size[start - 1] if start else 0) + PIECE
        fit = ends[: np.searchsorted(size[ends - 1], room, "right")]
        stop = int(fit[-1]) if len(fit) and fit[-1] > start else int(ends[np.searchsorted(ends, start, "right")])
        yield batch.slice(start, stop - start)
        start = stop


def _ranks(code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How often each entry's code has come so far, itself included; the codes; how often each comes."""
    n = len(code)
    bits = n.bit_length()
    packed = np.sort(code.astype(np.int64) << bits | np.arange(n))
    at, code = packed & ((1 << bits) - 1), packed >> bits
    first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
    size = np.diff(first, append=n)
    rank = np.empty(n, np.int64)
    rank[at] = np.arange(1, n + 1) - np.repeat(first, size)
    return rank, code[first], size


class _Counts:
    """Counts by part, kept in Arrow and numpy: no Python object for any part."""

    def __init__(self):
        self.parts, self.counts = pa.array([], pa.large_string()), np.zeros(0, np.int64)

    def slots(self, parts: pa.Array) -> np.ndarray:
        """Places of distinct parts; new ones get a place and the count 0."""
        parts = parts.cast(pa.large_string())
        found = pc.index_in(parts, value_set=self.parts)
        new = pc.is_null(found)
        fresh = new.to_numpy(zero_copy_only=False)
        slots = pc.fill_null(found, 0).to_numpy(zero_copy_only=False).astype(np.int64)
        slots[fresh] = len(self.parts) + np.arange(int(fresh.sum()))
        self.parts = pa.concat_arrays([self.parts, parts.filter(new)])
        self.counts = np.concatenate([self.counts, np.zeros(int(fresh.sum()), np.int64)])
        return slots

    def carry(self, parts: pa.Array, before: np.ndarray) -> None:
        slots = self.slots(parts)  # may make room in counts
        self.counts[slots] = before

    def count(self, parts: pa.Array) -> np.ndarray:
        """Counts after each part."""
        coded = parts.dictionary_encode()
        code = coded.indices.to_numpy(zero_copy_only=False)
        slots = self.slots(coded.dictionary)
        rank, codes, size = _ranks(code)
        rank += self.counts[slots][code]
        self.counts[slots[codes]] += size
        return rank


def _totals(separator: str):
    """Counts by range and part, of as many texts as fit a piece."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.take(pc.sort_indices(batch["_range"]))
            for piece in _cut(batch, np.arange(1, batch.num_rows + 1)):
                lists = pc.split_pattern(piece["text"], separator)
                coded = lists.flatten().dictionary_encode()
                ranges = piece["_range"].to_numpy().astype(np.int64)
                n = len(coded.dictionary)
                pairs = np.repeat(ranges, pc.list_value_length(lists).to_numpy()) * n + coded.indices.to_numpy()
                pairs, size = np.unique(pairs, return_counts=True)
                yield pa.record_batch([coded.dictionary.take(pa.array(pairs % n)), pa.array((pairs // n).astype(np.int32)), pa.array(size.astype(np.int64))], ["_part", "_range", "_n"])

    return emit


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of one range each, sorted; no piece ends between rows of equal order. Carried counts and texts come in pieces apart."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        if held:
            batch = pa.concat_batches([*held, batch])
        ranges, keys = batch["_range"].to_numpy(), pc.fill_null(batch["_key"], -LAST - 1).to_numpy()
        texts = pc.is_null(batch["_before"]).to_numpy(zero_copy_only=False)
        turn = (ranges[1:] != ranges[:-1]) | (texts[1:] != texts[:-1])
        ends = np.flatnonzero(turn | (keys[1:] != keys[:-1]) | ~texts[1:]) + 1
        if not len(ends):  # all of one order: the next batch may have more of it
            held = [batch]
            continue
        done, held = batch.slice(0, int(ends[-1])), [batch.slice(int(ends[-1]))]
        start = 0
        for stop in [*(np.flatnonzero(turn[: done.num_rows - 1]) + 1).tolist(), done.num_rows]:
            yield from _cut(done.slice(start, stop - start), ends[(ends > start) & (ends <= stop)] - start)
            start = stop
    yield from held


def _running(separator: str, names: list[str]):
    """Splits and counts the texts of a range in order, after what is carried into it."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, counts = None, _Counts()
        for piece in _whole(batches):
            if piece["_range"][0].as_py() != here:
                here, counts = piece["_range"][0].as_py(), _Counts()
            if piece["_before"][0].is_valid:
                counts.carry(piece["text"], piece["_before"].to_numpy())
                continue
            lists, keys = pc.split_pattern(piece["text"], separator), piece["_key"].to_numpy()
            parts, size = lists.flatten(), pc.list_value_length(lists).to_numpy().astype(np.int64)
            row = np.repeat(np.arange(len(size)), size)
            place = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
            if (keys[1:] == keys[:-1]).any():  # texts of equal order advance place by place together
                order = np.lexsort((place, keys[row]))
                parts, row, place = parts.take(pa.array(order)), row[order], place[order]
            for k in range(0, len(row), PARTS):
                some = parts.slice(k, PARTS)
                yield pa.record_batch([piece["_order"].take(pa.array(row[k : k + PARTS])), pa.array(place[k : k + PARTS]), some, pa.array(counts.count(some))], names)

    return emit


def running_parts(df: DataFrame, text: str, order: str, separator: str = " ", names: tuple[str, str, str] = ("place", "value", "n"), cuts: Cuts | None = None) -> DataFrame:
    """A row for each part of each text: ``order``, the part's place in the text from 0, the part, and how often it has come up to here.

    ``order`` is a whole number; parts come by it, then by their place; null order comes last. A null
    text has no parts. ``cuts``: where to cut the order, by default at its quantiles. Texts of equal
    order are held at once. What is carried into a range are its parts that have come before.
    """
    texts = df.select(F.col(order).cast("long").alias("_order"), F.col(text).alias("text")).where("text is not null")
    cuts = quantile_cuts(texts, "_order") if cuts is None else cuts
    last = len(cuts.values)
    texts = texts.withColumn("_range", F.when(F.col("_order").isNull(), last).otherwise(cuts.place(F.col("_order"))).cast("int"))
    totals = texts.select("_range", "text").mapInArrow(_totals(separator), "_part string, _range int, _n long")
    totals = totals.repartition("_part").groupBy("_part", "_range").agg(F.sum("_n").alias("_n"))  # by part alone: the window needs no other shuffle
    before = Window.partitionBy("_part").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select("_range", F.lit(None).cast("long").alias("_key"), F.lit(None).cast("long").alias("_order"), F.col("_part").alias("text"), F.sum("_n").over(before).alias("_before"))
    rows = texts.select("_range", F.coalesce("_order", F.lit(LAST)).alias("_key"), "_order", "text", F.lit(None).cast("long").alias("_before"))
    dealt = rows.unionByName(carried.where("_before is not null")).repartitionById(last + 1, F.col("_range"))
    place, value, n = names
    return dealt.sortWithinPartitions("_range", "_key").mapInArrow(_running(separator, [order, place, value, n]), f"`{order}` long, `{place}` long, `{value}` string, `{n}` long")
