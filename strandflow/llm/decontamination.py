"""Benchmark decontamination by a prefix-filtered set join.

An item window (``size`` consecutive words, or the whole of a shorter item) is the
set of its shingles of ``span`` words. Shingles are ordered by rarity, by their
counts over the whole corpus. A window must be contained whole, so the necessary
prefix of its set is one shingle: the rarest. Spark joins the prefix tokens of all
windows with the places in the corpus where such shingles stand; the shingle's
place in the window says where the window would begin (position bound), it must
lie inside the document (length bound), and then the words themselves are
compared, over a stretch the size of the window.

A bit filter of bounded size, made from the shingles of all windows and then from
their prefixes, is all that is broadcast; what it lets through by mistake finds no
partner in the join. Popular prefixes meet an index with one row a window, which
Spark broadcasts if it is small and else may split by skew.

Null and empty texts have no words. Items without id, text or words are left out;
repeated items count once. Each row of the documents is judged by its own text,
whatever its id; repeated rows give repeated results, an empty table none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandflow.llm import bit_filter
from strandflow.llm import textkernels as K
from strandflow.llm.tables import materialize

#: Words of a shingle.
SPAN = 3
PLACES = "doc_id long, n_words long, digest string, places array<struct<token:long,at:long,before:int,context:string>>"


def _words(data: np.ndarray, at: np.ndarray) -> K.Words:
    return K.words(data, at, K.ALNUM, K.LOWER)


def _item_windows(size: int, span: int):
    """(item_id, win, n, shingles) of each window; ``win``: its n words, parted by blanks."""

    @K.tidy
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, at in K.pieces(batch.column("text")):
                words = _words(data, at)
                hashes = words.hashes()
                for d in range(hi - lo):
                    a, b = int(words.first[d]), int(words.first[d + 1])
                    n = min(size, b - a)
                    if not n:
                        continue
                    own = words.text(a, b)
                    shingles = K.windows(hashes[a:b], min(span, n)).view(np.int64)
                    some = n - min(span, n) + 1
                    for i in range(0, b - a - n + 1, 1 << 14):
                        places = range(i, min(i + (1 << 14), b - a - n + 1))
                        wins = [b" ".join(own[p : p + n]).decode() for p in places]
                        lists = np.lib.stride_tricks.sliding_window_view(shingles, some)[places.start : places.stop]
                        edges = pa.array(np.arange(0, lists.size + 1, some).astype(np.int32))
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([batch.column("item_id")[lo + d].as_py()] * len(wins)), pa.array(wins), pa.array(np.full(len(wins), n, np.int32)), pa.ListArray.from_arrays(edges, pa.array(lists.ravel()))],
                            ["item_id", "win", "n", "shingles"],
                        )

    return emit


def _hits(words: K.Words, lengths: list[int], table: np.ndarray | None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, place, hash) of the shingles of a piece that may be wanted; all inside one document."""
    doc_end = np.repeat(words.first[1:], words.counts())
    for length in lengths:
        found = K.windows(words.hashes(), length)
        at = np.flatnonzero(bit_filter.test(table, found))
        at = at[at + length <= doc_end[at]]
        yield length, at, found[at]


def _counter(lengths: list[int], shared):
    @K.tidy
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [h for _, _, data, at in K.pieces(batch.column("text")) for _, _, h in _hits(_words(data, at), lengths, shared.value)]
            token, n = np.unique(np.concatenate([*found, np.zeros(0, np.uint64)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(n.astype(np.int64))], ["token", "n"])

    return count


def _placer(size: int, lengths: list[int], shared):
    """Each document's number of words, and the places of prefix tokens with the words around them."""
    kind = pa.list_(pa.struct([("token", pa.int64()), ("at", pa.int64()), ("before", pa.int32()), ("context", pa.string())]))

    @K.tidy
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, at in K.pieces(batch.column("text")):
                words = _words(data, at)
                raw = data.tobytes()
                places: list[list[dict]] = [[] for _ in range(hi - lo)]
                for length, where, token in _hits(words, lengths, shared.value):
                    doc = np.searchsorted(words.first, where, "right") - 1
                    for p, d, t in zip(where.tolist(), doc.tolist(), token.view(np.int64).tolist(), strict=True):
                        a, b = int(words.first[d]), int(words.first[d + 1])
                        begin = max(a, p + length - size)
                        context = b" ".join(words.text(begin, min(b, p + size))).decode()
                        places[d].append({"token": t, "at": p - a, "before": p - begin, "context": context})
                digest = [hashlib.sha256(raw[at[d] : at[d + 1]]).hexdigest() if places[d] else None for d in range(hi - lo)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(lo, hi - lo), pa.array(words.counts()), pa.array(digest, pa.string()), pa.array(places, kind)], ["doc_id", "n_words", "digest", "places"]
                )

    return emit


def _found(docs: DataFrame, benchmark: DataFrame, size: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents with ``uid``, n_words and digest; (uid, win, start, stop) of each occurrence; (win, item_id))."""
    spark = docs.sparkSession
    items = benchmark.selectExpr("cast(item_id as string) item_id", "text").where("item_id is not null and text is not null")
    rows = materialize(items.mapInArrow(_item_windows(size, SPAN), "item_id string, win string, n int, shingles array<long>"))
    wins = rows.groupBy("win").agg(F.first("n").alias("n"), F.first("shingles").alias("shingles"))
    lengths = [r[0] for r in rows.select(F.least("n", F.lit(SPAN)).alias("length")).distinct().orderBy("length").collect()]
    tokens = materialize(wins.select("win", "n", F.posexplode("shingles").alias("place", "token")))

    known = tokens.select("token").distinct()
    shared = spark.sparkContext.broadcast(bit_filter.build(known, F.col("token")))
    counts = docs.select("text").mapInArrow(_counter(lengths, shared), "token long, n long").groupBy("token").agg(F.sum("n").alias("many"))
    ranked = tokens.join(counts, "token", "left").groupBy("win").agg(F.min(F.struct(F.coalesce("many", F.lit(0)).alias("many"), "token", "place", "n")).alias("rarest"))
    index = materialize(ranked.select("win", "rarest.token", "rarest.place", "rarest.n"))

    shared = spark.sparkContext.broadcast(bit_filter.build(index.select("token").distinct(), F.col("token")))
    base = docs.select("doc_id", "text").mapInArrow(_placer(size, lengths, shared), PLACES)
    base = materialize(base.withColumn("uid", F.monotonically_increasing_id()))
    placed = base.select("uid", F.explode("places").alias("p")).select("uid", "p.*")
    near = placed.join(index, "token").where("place <= before")
    stretch = F.expr("slice(split(context, ' '), before - place + 1, n)")
    met = near.where((F.size(stretch) == F.col("n")) & (F.concat_ws(" ", stretch) == F.col("win")))
    start = F.col("at") - F.col("place")
    return base.drop("places"), met.select("uid", "win", start.alias("start"), (start + F.col("n")).alias("stop")).distinct(), rows.select("win", "item_id").distinct()


def _items_of(found: DataFrame, items: DataFrame) -> DataFrame:
    """(uid, items): the sorted ids of the items with occurring windows."""
    each = found.select("uid", "win").distinct().join(items, "win").select("uid", "item_id").distinct()
    return each.groupBy("uid").agg(F.array_sort(F.collect_list("item_id")).alias("items"))


def find_contamination(docs: DataFrame, benchmark: DataFrame, size: int = 8, least_items: int = 2) -> DataFrame:
    """For each row of ``docs``: its words, the words inside item windows, the items, and whether there are ``least_items``."""
    base, found, items = _found(docs.selectExpr("cast(doc_id as long) doc_id", "text"), benchmark, size)
    found = materialize(found)
    spans = found.groupBy("uid").agg(F.array_sort(F.collect_set(F.struct("start", "stop"))).alias("spans"))
    nothing = F.struct(F.lit(0).cast("long").alias("upto"), F.lit(0).cast("long").alias("n"))

    def step(acc, s):
        more = F.greatest(F.lit(0).cast("long"), s["stop"] - F.greatest(acc["upto"], s["start"]))
        return F.struct(F.greatest(acc["upto"], s["stop"]).alias("upto"), (acc["n"] + more).alias("n"))

    hit = spans.select("uid", F.aggregate("spans", nothing, step)["n"].alias("n_hit"))
    out = base.join(hit.join(_items_of(found, items), "uid"), "uid", "left").withColumn("items", F.coalesce("items", F.array().cast("array<string>")))
    many = F.size("items").cast("long")
    return out.select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), many.alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), (many >= least_items).alias("contaminated"), "items",
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, size: int = 8, least_items: int = 1) -> DataFrame:
    """The rows of ``docs`` with windows of fewer than ``least_items`` items, all columns unchanged. Rows with the same text share their lot."""
    base, found, items = _found(docs.selectExpr("cast(null as long) doc_id", "text"), benchmark, size)
    dirty = _items_of(found, items).where(F.size("items") >= least_items)
    gone = materialize(base.where("digest is not null").join(dirty, "uid", "left_semi").select("digest").distinct())
    return bit_filter.without(docs, F.sha2(F.col("text").cast("binary"), 256), gone)
