"""Media columns as content-defined chunks.

A payload is cut where a rolling gear hash over its last 32 bytes has its top
``bits`` bits at zero, at least ``least`` and at most ``most`` bytes apart, so an
insertion moves only nearby cuts. Chunks are known by SHA-256.

Every medium has an ordered chunk list, and every distinct chunk one row in a
chunk store, keyed by digest; both are written to the shared folder, and all
reports come from lists and store as read back. Chunks that two or more media may
hold are found by counting digests in Spark (a first pass that moves digests
alone, then a bit filter of bounded size) and reach their media by a join. A chunk
that only one medium holds is written beside that medium's list, as the only store
row of its digest, and is read from there, so it does not travel. Every chunk is
checked against its digest on reading, so what comes back is what was stored.

The stored form of a medium is a header (magic, unit, number of chunks), its
chunk list (length and digest of each), and the samples in order. Its
samples are unsigned 8-bit.

Null texts count as empty. Rows are kept one for one, whatever their ids; equal
texts give equal values.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandflow.llm import bit_filter
from strandflow.llm import textkernels as K
from strandflow.llm.tables import materialize

MAGIC = b"GCH1"
UNIT = 192
REACH = 32  # bytes that the rolling hash sees
PLACED = 1 << 22  # payload bytes that are handed on together
_GEAR = np.random.default_rng(77).integers(0, 1 << 32, 256, dtype=np.uint32)
RESULT = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
_NAMES = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
PARTS = "doc_id long, n_bytes long, complete boolean, parts array<struct<digest:binary,size:int,shared:boolean,data:binary>>"


def payload_of(text: bytes, unit: int = UNIT) -> bytes:
    """The text with spaces up to a positive multiple of the unit."""
    return text.ljust(max(1, -(-len(text) // unit)) * unit, b" ")


def gear(data: np.ndarray) -> np.ndarray:
    """Rolling hash that ends at each byte: sum of the gears of the last 32 bytes, each shifted by its age."""
    h = _GEAR[data]
    for step in (1, 2, 4, 8, 16):
        h[step:] = h[step:] + (h[:-step] << np.uint32(step))
    return h


def cuts(length: int, places: np.ndarray, least: int, most: int) -> list[int]:
    """Ends of the chunks of a payload; ``places``: ends that the hash proposes."""
    out, last, k = [], 0, 0
    places = places.tolist()
    while length - last > most or k < len(places):
        while k < len(places) and places[k] - last < least:
            k += 1
        end = places[k] if k < len(places) and places[k] - last <= most else last + most
        if end >= length:
            break
        out.append(end)
        last = end
    return [*out, length]


class Cutter:
    def __init__(self, bits: int = 11, least: int = 512, most: int = 8192):
        if not REACH <= least <= most:
            raise ValueError(f"chunks must be at least {REACH} bytes, so that cuts don't depend on what comes before the chunk")
        self.bits, self.least, self.most = bits, least, most

    def payloads(self, column: pa.Array) -> Iterator[tuple[int, int, bytes, list[int]]]:
        """(row, bytes of text, payload, ends of its chunks)."""
        for lo, hi, data, at in K.pieces(column):
            raw = data.tobytes()
            padded = [payload_of(raw[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            whole = np.frombuffer(b"".join(padded), np.uint8)
            first = np.concatenate([[0], np.cumsum([len(p) for p in padded])])
            place = np.flatnonzero(gear(whole) >> np.uint32(32 - self.bits) == 0) + 1
            edge = np.searchsorted(place, first, "right")
            for d in range(hi - lo):
                yield lo + d, int(at[d + 1] - at[d]), padded[d], cuts(len(padded[d]), place[edge[d] : edge[d + 1]] - first[d], self.least, self.most)


def split(payload: bytes, ends: list[int]) -> list[bytes]:
    return [payload[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def stored_form(parts: list[tuple[bytes, bytes]]) -> bytes:
    """Header, chunk list and samples; ``parts``: (digest, chunk)."""
    return b"".join([MAGIC, struct.pack("<HI", UNIT, len(parts)), *(struct.pack("<I", len(x)) + d for d, x in parts), *(x for _, x in parts)])


def read_back(media: bytes) -> bytes:
    """The payload of a stored form, each chunk checked against the list."""
    if media[:4] != MAGIC:
        raise ValueError("not a chunked medium")
    n = struct.unpack_from("<HI", media, 4)[1]
    at = 10 + 36 * n
    out = []
    for i in range(n):
        size = struct.unpack_from("<I", media, 10 + 36 * i)[0]
        chunk = media[at : at + size]
        if hashlib.sha256(chunk).digest() != media[14 + 36 * i : 46 + 36 * i]:
            raise ValueError("a chunk differs from its digest")
        out.append(chunk)
        at += size
    return b"".join(out)


def features(payload: bytes, chunks: int) -> str:
    """Chunk count, mean, mean square and crossings of the mean line, from the samples as read."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64)
    n, total = len(x), int(x.sum())
    above = x * n > total
    return f"chunks={chunks};sum={total};square={int((x * x).sum())};crossings={int(np.count_nonzero(above[1:] != above[:-1]))}"


def report(n_bytes: int, parts: list[tuple[bytes, bytes]]) -> tuple:
    media = stored_form(parts)
    payload = read_back(media)
    return (n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), features(payload, len(parts)))


def _reports(ids: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 7
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([ids, *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], _NAMES)


def _key(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "little", signed=True)


def _digests(cutter: Cutter):
    """The distinct keys of the chunks of each payload."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [list({_key(hashlib.sha256(x).digest()) for x in split(payload, ends)}) for _, _, payload, ends in cutter.payloads(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.list_(pa.int64()))], ["keys"])

    return emit


def _placed(cutter: Cutter, shared):
    """The parts of each medium, with the data of chunks that it may share and, at their first place, of those only it holds."""
    kind = pa.list_(pa.struct([("digest", pa.binary()), ("size", pa.int32()), ("shared", pa.bool_()), ("data", pa.binary())]))

    def parts_of(pack: zstandard.ZstdCompressor, payload: bytes, ends: list[int]) -> list[dict]:
        parts = [(hashlib.sha256(x).digest(), x) for x in split(payload, ends)]
        common = bit_filter.test(shared.value, np.array([_key(d) for d, _ in parts]).view(np.uint64))
        out, seen = [], set()
        for (d, x), s in zip(parts, common.tolist(), strict=True):
            out.append({"digest": d, "size": len(x), "shared": s, "data": None if d in seen and not s else pack.compress(x)})
            seen.add(d)
        return out

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            ids, first, held = batch.column("doc_id"), 0, 0
            n_bytes, complete, media = [], [], []
            for row, n, payload, ends in cutter.payloads(batch.column("text")):
                parts = parts_of(pack, payload, ends)
                n_bytes.append(n)
                complete.append(not any(x["shared"] for x in parts))
                media.append(parts)
                held += len(payload)
                if held > PLACED or row + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays(
                        [ids.slice(first, len(media)), pa.array(n_bytes, pa.int64()), pa.array(complete, pa.bool_()), pa.array(media, kind)],
                        ["doc_id", "n_bytes", "complete", "parts"],
                    )
                    first, held = row + 1, 0
                    n_bytes, complete, media = [], [], []

    return place


def _assembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        rows = []
        for n_bytes, parts in zip(batch.column("n_bytes").to_pylist(), batch.column("parts").to_pylist(), strict=True):
            parts = sorted(parts, key=lambda p: p["seq"])
            held = {p["digest"]: p["data"] for p in parts if p["data"] is not None}
            rows.append(report(n_bytes, [(p["digest"], unpack.decompress(held[p["digest"]])) for p in parts]))
        yield _reports(batch.column("doc_id"), rows)


def store_media(docs: DataFrame, cutter: Cutter | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(media, chunk lists, chunk store) of all rows of ``docs``, as read back from the shared folder.

    Media have a row for each row of ``docs``; ``complete`` ones share no chunk.
    Lists have a row for each chunk: medium, doc_id, n_bytes, complete, seq,
    digest, size, shared, and the data if the chunk is the medium's own (at its
    first place). The store has (digest, data, pooled), zstandard-compressed, one
    row a digest; ``pooled`` rows are those of chunks that may be shared.
    """
    cutter = cutter or Cutter()
    spark = docs.sparkSession
    docs = docs.selectExpr("cast(doc_id as long) doc_id", "text")
    keys = docs.select("text").mapInArrow(_digests(cutter), "keys array<long>").select(F.explode("keys").alias("k"))
    common = materialize(keys.groupBy("k").count().where("count > 1").select("k"))
    bits = bit_filter.bits_for(common.count())
    shared = spark.sparkContext.broadcast(bit_filter.build(common, F.col("k"), bits))
    media = materialize(docs.mapInArrow(_placed(cutter, shared), PARTS).withColumn("medium", F.monotonically_increasing_id()))
    chunks = media.select("medium", "doc_id", "n_bytes", "complete", F.posexplode("parts").alias("seq", "part")).select("medium", "doc_id", "n_bytes", "complete", "seq", "part.*")
    pooled = materialize(chunks.where("shared").groupBy("digest").agg(F.min("data").alias("data")))
    own = chunks.where("not shared and data is not null").select("digest", "data", F.lit(False).alias("pooled"))
    return media, chunks.withColumn("data", F.when(~F.col("shared"), F.col("data"))), pooled.withColumn("pooled", F.lit(True)).unionByName(own)


def rebuild(media: DataFrame, lists: DataFrame, store: DataFrame) -> DataFrame:
    """Puts each medium together again from its chunk list and the store; only pooled chunks travel by a join."""
    rest = lists.where("not complete")
    borrowed = rest.where("shared").select("medium", "doc_id", "n_bytes", "seq", "digest").join(store.where("pooled").select("digest", "data"), "digest")
    every = borrowed.unionByName(rest.where("not shared").select("medium", "doc_id", "n_bytes", "seq", "digest", "data"))
    joined = every.groupBy("medium").agg(F.first("doc_id").alias("doc_id"), F.first("n_bytes").alias("n_bytes"), F.collect_list(F.struct("seq", "digest", "data")).alias("parts"))
    numbered = F.transform("parts", lambda p, i: F.struct(i.alias("seq"), p["digest"].alias("digest"), p["data"].alias("data")))
    complete = media.where("complete").select("doc_id", "n_bytes", numbered.alias("parts"))
    return complete.unionByName(joined.select("doc_id", "n_bytes", "parts")).mapInArrow(_assembled, RESULT)


def media_reports(docs: DataFrame, cutter: Cutter | None = None) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): digests and features of its medium as read back."""
    return rebuild(*store_media(docs, cutter))
