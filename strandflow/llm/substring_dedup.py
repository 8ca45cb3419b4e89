"""Substring dedup by relative Lempel-Ziv parsing against indexed reference blocks.

Each document is cut into reference blocks: the words of ``BLOCK`` consecutive
windows of ``size`` words. A document may only copy from documents with a smaller
doc_id, and is parsed greedily against the blocks that can give it a factor: at
the next place whose window stands in one of them, the longest match from there,
over all its places in all those blocks, is a factor; its words are compared
themselves. The parse goes on at the factor's boundary, with the first window
that is not inside it, so a factor that begins before the last one's end is found.
Factors of ``size`` words or more are duplicate spans.

Which blocks those are is settled by Spark. The index holds, for each window that
can repeat, the least doc_id in which it starts and its block there; a join asks
it for every window. Documents with the same words have the blocks of the least of
them. Each window is represented by its minimiser (the least hash of its
``size - reach + 1`` runs of ``reach`` words): equal windows have equal minimisers, so
one whose minimiser occurs in one word sequence alone is not asked for. The text
of a wanted block is sent once a document that wants it; popular blocks are dealt
to several tasks.

Null texts have no words. Rows without doc_id neither lose words nor count as
references. Rows that share a doc_id are parts of one document: they don't take
words from each other. Repeated rows give repeated results; an empty table none.
Hashes of 64 bits choose blocks; what goes is decided by the words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandflow.llm import bit_filter
from strandflow.llm import textkernels as K
from strandflow.llm.tables import materialize, spread_join

SCHEMA = "doc_id long, n_words long, spans array<struct<start:long,stop:long>>, kept string"
REACH = 16
#: Windows of a reference block.
BLOCK = 128


def _sliding_least(a: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` consecutive values."""
    done = 1
    while done < width:
        step = min(done, width - done)
        a = np.minimum(a[:-step], a[step:])
        done += step
    return a


def _windows(words: K.Words, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place, document and hash of each window inside one document."""
    found = K.windows(words.hashes(), size)
    doc = words.docs()[: len(found)]
    inside = np.flatnonzero(np.arange(len(found)) + size <= words.first[1:][doc])
    return inside, doc[inside], found[inside]


def _minimisers(words: K.Words, size: int) -> np.ndarray:
    """Minimiser of the window at each place; windows that cross documents are not told apart."""
    reach = min(REACH, size)
    return _sliding_least(K.windows(words.hashes(), reach, 1), size - reach + 1)


def _lists(values: np.ndarray, doc: np.ndarray, n: int) -> pa.Array:
    """A list for each of ``n`` documents; ``doc`` ascends."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(n + 1)).astype(np.int32)), pa.array(values.view(np.int64)))


def _distinct(values: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Places of the distinct values of each document, its first ones, by document."""
    order = np.lexsort((values, doc))
    new = np.ones(len(values), bool)
    new[1:] = (values[order][1:] != values[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    return order[new]


def _wholes(words: K.Words, size: int) -> np.ndarray:
    """Key of each document's word sequence; 0 for one that is too short for a window."""
    hashes, first = words.hashes(), words.first.tolist()
    digest = [hashlib.blake2b(hashes[a:b].tobytes(), digest_size=8).digest() if b - a >= size else bytes(8) for a, b in zip(first[:-1], first[1:], strict=True)]
    return np.frombuffer(b"".join(digest), np.uint64)


def _block_keys(whole: np.ndarray, number: np.ndarray) -> np.ndarray:
    return K.mix(K.fold(whole, number.astype(np.uint64)))


def _sequences(size: int):
    """Key, block keys and distinct minimisers of each document."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, at in K.pieces(batch.column("text")):
                words = K.words(data, at)
                place, doc, _ = _windows(words, size)
                least = _minimisers(words, size)[place]
                run = np.ones(len(least), bool)
                run[1:] = (least[1:] != least[:-1]) | (doc[1:] != doc[:-1])
                values, owner = least[run], doc[run]
                some = _distinct(values, owner)
                whole = _wholes(words, size)
                many = np.where(whole > 0, -(-(words.counts() - size + 1) // BLOCK), 0)
                holder = np.repeat(np.arange(hi - lo), many)
                number = np.arange(len(holder)) - np.repeat(np.cumsum(many) - many, many)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(lo, hi - lo), pa.array(whole.view(np.int64)), _lists(_block_keys(whole[holder], number), holder, hi - lo), _lists(values[some], owner[some], hi - lo)],
                    ["doc_id", "whole", "blocks", "minimisers"],
                )

    return emit


def _asked(size: int, shared):
    """The distinct windows of each document whose minimiser may repeat, with their blocks."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, at in K.pieces(batch.column("text")):
                words = K.words(data, at)
                place, doc, window = _windows(words, size)
                hit = np.flatnonzero(bit_filter.test(shared.value, _minimisers(words, size)[place]))
                hit = hit[_distinct(window[hit], doc[hit])]
                place, doc, window = place[hit], doc[hit], window[hit]
                block = _block_keys(_wholes(words, size)[doc], (place - words.first[doc]) // BLOCK)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), _lists(window, doc, hi - lo), _lists(block, doc, hi - lo)], ["doc_id", "hashes", "blocks"])

    return emit


def _texts_of(size: int, shared):
    """(block, words) of blocks that may be wanted, equal ones of a batch once."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[int, str] = {}
            for lo, hi, data, at in K.pieces(batch.column("text")):
                words = K.words(data, at)
                whole, counts = _wholes(words, size), words.counts()
                for d in np.flatnonzero(whole > 0).tolist():
                    number = np.arange(-(-(counts[d] - size + 1) // BLOCK))
                    keys = _block_keys(np.repeat(whole[d], len(number)), number)
                    for i in np.flatnonzero(bit_filter.test(shared.value, keys)).tolist():
                        key = int(keys[i].view(np.int64))
                        if key not in found:
                            a = int(words.first[d]) + i * BLOCK
                            found[key] = b" ".join(words.text(a, min(a + BLOCK + size - 1, int(words.first[d + 1])))).decode()
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.string())], ["block", "words"])

    return emit


@dataclass
class Line:
    """Words of one text, parted by single blanks."""

    hashes: np.ndarray
    raw: bytes
    starts: np.ndarray
    ends: np.ndarray

    def text(self, a: int, b: int) -> bytes:
        return self.raw[self.starts[a] : self.ends[b - 1]] if b > a else b""


@dataclass
class Reference:
    """Blocks laid end to end in one line; ``windows`` ascend, ``place`` is where each begins, ``stop`` the end of its block."""

    line: Line
    windows: np.ndarray
    place: np.ndarray
    stop: np.ndarray

    @classmethod
    def of(cls, blocks: pa.Array, size: int) -> Reference:
        data, at = K.string_bytes(blocks)
        words = K.words(data, at)
        place, block, window = _windows(words, size)
        order = np.argsort(window, kind="stable")
        return cls(Line(words.hashes(), data.tobytes(), words.starts, words.ends), window[order], place[order], words.first[1:][block[order]])

    def longest(self, own: Line, p: int, window: int) -> tuple[int, int]:
        """(length, place in the blocks) of the longest match of the words from ``p``."""
        lo, hi = np.searchsorted(self.windows, window, "left"), np.searchsorted(self.windows, window, "right")
        best, at, left = 0, -1, len(own.hashes) - p
        for q, stop in zip(self.place[lo:hi].tolist(), self.stop[lo:hi].tolist(), strict=True):
            most = min(left, stop - q)
            if most <= best:
                continue
            apart = own.hashes[p : p + most] != self.line.hashes[q : q + most]
            length = int(apart.argmax()) if apart.any() else most
            if length > best and own.text(p, p + length) != self.line.text(q, q + length):
                pairs = zip(own.text(p, p + length).split(b" "), self.line.text(q, q + length).split(b" "), strict=False)
                length = next((i for i, (x, y) in enumerate(pairs) if x != y), length)
            if length > best:
                best, at = length, q
        return best, at


def factors(own: Line, windows: np.ndarray, reference: Reference, size: int) -> list[tuple[int, int, int]]:
    """(start, stop, place in the blocks) of the greedy factors of at least ``size`` words, by start. ``windows``: of ``own``, by place."""
    hits = np.flatnonzero(K.in_sorted(windows, reference.windows) >= 0)
    out, p = [], 0
    while (i := int(np.searchsorted(hits, p))) < len(hits):
        p = int(hits[i])
        length, q = reference.longest(own, p, windows[p])
        if length >= size:
            out.append((p, p + length, q))
        p += max(1, length - size + 1)
    return out


def joined(found: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Spans of factors that meet or overlap, as one."""
    out: list[tuple[int, int]] = []
    for start, stop, _ in found:
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], stop))
        else:
            out.append((start, stop))
    return out


def _result(ids: pa.Array, n_words: list, spans: list, kept: list) -> pa.RecordBatch:
    kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
    some = [[{"start": a, "stop": b} for a, b in s] for s in spans]
    return pa.RecordBatch.from_arrays([ids, pa.array(n_words, pa.int64()), pa.array(some, kind), pa.array(kept, pa.string())], ["doc_id", "n_words", "spans", "kept"])


def _in_filter(batch: pa.RecordBatch, table: np.ndarray | None) -> np.ndarray:
    key = batch.column("key").fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64)
    return bit_filter.test(table, key) & batch.column("doc_id").is_valid().to_numpy(zero_copy_only=False)


def _untouched(shared):
    """Reports rows that no block is wanted for, for sure."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(~_in_filter(batch, shared.value)))
            for lo, hi, data, at in K.pieces(batch.column("text")):
                raw, edge = data.tobytes(), at.tolist()
                words = [raw[a:b].split() for a, b in zip(edge[:-1], edge[1:], strict=True)]
                yield _result(batch.column("doc_id").slice(lo, hi - lo), [len(w) for w in words], [()] * len(words), [b" ".join(w).decode() for w in words])

    return emit


def _chosen(shared):
    """Rows whose key may be in the filter."""

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_in_filter(batch, shared.value))).select(["doc_id", "text"])

    return choose


def _parsed(size: int):
    """Parses each text against the blocks beside it."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks = batch.column("blocks")
            for lo, hi, data, at in K.pieces(batch.column("text")):
                words = K.words(data, at)
                every = K.windows(words.hashes(), size)
                n_words, spans, kept = words.counts().tolist(), [], []
                for d in range(hi - lo):
                    a, b = int(words.first[d]), int(words.first[d + 1])
                    own = words.text(a, b)
                    found: list[tuple[int, int]] = []
                    if blocks[lo + d].is_valid and b - a >= size:
                        many = words.ends[a:b] - words.starts[a:b]
                        ends = np.cumsum(many + 1) - 1
                        line = Line(words.hashes()[a:b], b" ".join(own), ends - many, ends)
                        found = joined(factors(line, every[a : b - size + 1], Reference.of(blocks[lo + d].values, size), size))
                    spans.append(found)
                    edges = [0, *(x for s in found for x in s), b - a]
                    kept.append(b" ".join([w for i in range(0, len(edges), 2) for w in own[edges[i] : edges[i + 1]]]).decode())
                yield _result(batch.column("doc_id").slice(lo, hi - lo), n_words, spans, kept)

    return parse


def wanted_blocks(docs: DataFrame, size: int = 50) -> DataFrame:
    """(doc_id, block): for each document, the blocks in documents with smaller doc_ids that hold its windows."""
    spark = docs.sparkSession
    docs = docs.selectExpr("cast(doc_id as long) doc_id", "text").where("doc_id is not null and text is not null")
    rows = materialize(docs.mapInArrow(_sequences(size), "doc_id long, whole long, blocks array<long>, minimisers array<long>"))
    rows = rows.where("whole <> 0")
    first = rows.groupBy("whole").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most")
    copies = rows.join(first, "whole").where("doc_id > least").select("doc_id", F.explode("blocks").alias("block"))

    minimisers = rows.select("whole", F.explode("minimisers").alias("h")).groupBy("h").agg(F.min("whole").alias("a"), F.max("whole").alias("b")).where("a < b")
    repeated = materialize(minimisers.select("h"))
    shared = spark.sparkContext.broadcast(bit_filter.build(repeated, F.col("h")))
    asked = docs.mapInArrow(_asked(size, shared), "doc_id long, hashes array<long>, blocks array<long>").where("size(hashes) > 0")
    windows = asked.select("doc_id", F.explode(F.arrays_zip("hashes", "blocks")).alias("w")).select("doc_id", F.col("w.hashes").alias("h"), F.col("w.blocks").alias("block"))
    index = windows.groupBy("h").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.min_by("block", "doc_id").alias("block")).where("least < most").select("h", "least", "block")
    found = windows.select("doc_id", "h").join(index, "h").where("doc_id > least").select("doc_id", "block")
    return found.unionByName(copies).distinct()


def remove_repeats(docs: DataFrame, size: int = 50) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): its number of words, the duplicate spans (in words) and the words that stay, parted by single blanks."""
    spark = docs.sparkSession
    pairs = materialize(wanted_blocks(docs, size))
    sizes = materialize(pairs.groupBy("block").agg(F.count("*").alias("n")))
    shared = spark.sparkContext.broadcast(bit_filter.build(sizes, F.col("block")))
    texts = docs.select("text").where("text is not null").mapInArrow(_texts_of(size, shared), "block long, words string")
    texts = texts.join(sizes.select("block"), "block", "left_semi").groupBy("block").agg(F.first("words").alias("words"))
    found = spread_join(pairs, texts, "block", "doc_id", sizes).groupBy("doc_id").agg(F.collect_list("words").alias("blocks"))

    ids = pairs.select("doc_id").distinct()
    shared = spark.sparkContext.broadcast(bit_filter.build(ids, F.xxhash64("doc_id")))
    keyed = docs.selectExpr("cast(doc_id as long) doc_id", "text").withColumn("key", F.xxhash64("doc_id"))
    clear = keyed.mapInArrow(_untouched(shared), SCHEMA)
    some = keyed.mapInArrow(_chosen(shared), "doc_id long, text string").join(found, "doc_id", "left")
    return clear.unionByName(some.mapInArrow(_parsed(size), SCHEMA))


def reports(docs: DataFrame, size: int = 50) -> DataFrame:
    """The counts and the SHA-256 of what stays."""
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return remove_repeats(docs, size).select("doc_id", "n_words", gone.alias("n_removed"), F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
