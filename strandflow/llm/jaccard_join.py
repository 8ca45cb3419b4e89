"""N-gram Jaccard join as a blocked sparse product of the document by n-gram incidence.

A document is the set of its distinct shingles of ``words`` consecutive words.
Documents with equal sets are one row of the matrix. Two rows link when
``den * |A and B| >= num * |A or B|``.

1. Blocks of columns. The hash range of the n-grams is cut into m column blocks,
   m above the largest symmetric difference that linked rows of a size class can
   have, so linked rows agree entirely in some block, and in at least
   (non-empty blocks - largest difference) of them. Contents of blocks are dealt
   to hash buckets, as many as their number asks for; a bucket's task finds the
   contents that two or more rows share, and a second pass sends only those to
   the join that counts, for each row and the least row of a shared content (its
   pivot), the blocks in common. Rows that meet others in fewer blocks than
   their sizes ask for are discarded.
2. Product against pivots. Rows that meet share a pivot, the least row there. A
   row leaves out the pivots it meets least, in all in less than half of the
   blocks its sizes ask for: of two linked rows' common blocks one remains.
   Overlaps with the pivot are counted exactly. With d the symmetric difference
   from the pivot and f = (den - num) * size - (den + num) * d, two rows x, y
   of a pivot link exactly when f(x) + f(y) + 2 * (den + num) * c >= 0, c being
   the number of their common differences. So every row is tested against the
   row of largest f by a maximum alone: large groups of near copies collapse
   into one class without pairs.
3. Remaining blocks. Only rows that this leaves open can link through common
   differences; they are multiplied, in blocks of rows, with the differences of
   their pivot's rows, accumulating c; pairs below the bound are discarded, and
   a block gives back a spanning forest of its links.

Connected components of the links are the classes. No step puts a group of
copies into one task, or emits its pairs.

Null and empty texts have an empty set and link with nothing. Fewer words than
a shingle count as one shingle. Rows are judged by their text whatever their
ids; a row without doc_id has no component. Shingles are compared by 64-bit hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from strandflow.llm import bit_filter
from strandflow.llm import textkernels as K
from strandflow.llm.components import components
from strandflow.llm.tables import fresh, materialize, spread_join

#: Column blocks for each block that may differ.
SPARE = 1.5
#: Rows of a pivot that step 3 takes together; larger groups are taken by pairs of parts.
PART_ROWS = 4096
#: Rows of a pivot that one task of a join by pivot takes.
JOIN_ROWS = 512
#: Keys of a hash bucket of column blocks, and the fewest buckets. A task takes one bucket, at about 50 bytes a key.
BUCKET_KEYS = 4_000_000
BUCKETS = 64


@dataclass(frozen=True)
class Rule:
    """Shingle length and least similarity num / den."""

    words: int = 3
    num: int = 90
    den: int = 100

    def differing(self, total: int) -> int:
        """Largest symmetric difference of linked sets with ``total`` elements in all."""
        return total * (self.den - self.num) // (self.den + self.num)

    def tops(self, most: int) -> list[int]:
        """Largest sizes of the size classes: linked sets are of one class or of neighbouring ones."""
        out = [1]
        while out[-1] < most:
            out.append(max(out[-1] + 1, out[-1] * self.den // self.num))
        return out


def shingle_sets(column: pa.Array, words: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, ascending distinct shingle hashes)."""
    for lo, hi, data, at in K.pieces(column):
        found = K.words(data, at, K.NON_BLANK, K.LOWER)
        hashes = found.hashes()
        every = K.windows(hashes, words)
        first = found.first.tolist()
        for d in range(hi - lo):
            a, b = first[d], first[d + 1]
            if b - a >= words:
                own = np.sort(every[a : b - words + 1])
                yield lo + d, own[np.concatenate([[True], own[1:] != own[:-1]])]
            else:
                yield lo + d, K.windows(hashes[a:b], b - a) if b > a else np.zeros(0, np.uint64)


def node_of(own: np.ndarray) -> int:
    """The identity of a set."""
    return int.from_bytes(hashlib.blake2b(own.tobytes(), digest_size=8).digest(), "little", signed=True)


def block_keys(own: np.ndarray, rule: Rule, tops: list[int]) -> Iterator[tuple[int, int, np.ndarray]]:
    """(slot, least number of shared blocks, keys of the column blocks) as a row of its class, and of the next."""
    n = len(own)
    mine = int(np.searchsorted(tops, n))
    weights = K.mix(own ^ np.uint64(0x5851F42D4C957F2D))
    for slot in (0, 1):
        top = tops[mine + slot]
        most = rule.differing(2 * top)
        if not most:
            continue
        m = int(SPARE * most) + 2
        block = ((own >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
        start = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
        content = np.add.reduceat(weights, start)
        block = block[start]
        need = len(block) - rule.differing(n + min(top, n * rule.den // rule.num))
        if len(block) <= most:  # linked rows might agree in empty blocks alone
            full = np.zeros(m, np.uint64)
            full[block] = content
            content, block = full, np.arange(m)
        yield slot, max(1, need), K.mix(content + block.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(top * 0xC2B2AE3D27D4EB4F & (1 << 64) - 1))


def _summary(rule: Rule):
    """Size and identity of each row's set, and how many column-block keys it has."""

    @K.tidy
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, node = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for row, own in shingle_sets(batch.column("text"), rule.words):
                n[row], node[row] = len(own), node_of(own)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), pa.array(node)], ["doc_id", "n", "node"])

    return emit


def _incidence(batches: Iterator[pa.RecordBatch], rule: Rule, most_keys: int = 2_000_000) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of rows of the incidence matrix: (key, row in ``node`` and ``meta`` of each entry; node; meta = need and slot). Equal sets of a block come once."""
    tops = rule.tops(1 << 10)
    keys: list[np.ndarray] = []
    nodes: list[int] = []
    metas: list[int] = []
    seen: set[int] = set()
    total = 0

    def block() -> tuple[np.ndarray, ...]:
        out = np.concatenate(keys), np.repeat(np.arange(len(keys), dtype=np.int32), [len(k) for k in keys]), np.array(nodes, np.int64), np.array(metas, np.int64)
        for held in (keys, nodes, metas, seen):  # not beside what is made of the block
            held.clear()
        return out

    for batch in batches:
        for _, own in shingle_sets(batch.column("text"), rule.words):
            if not len(own) or (node := node_of(own)) in seen:
                continue
            seen.add(node)
            while tops[-2] < len(own):
                tops = rule.tops(2 * tops[-1])
            for slot, need, found in block_keys(own, rule, tops):
                keys.append(found)
                nodes.append(node)
                metas.append(need * 2 + slot)
                total += len(found)
            if total >= most_keys:
                yield block()
                total = 0
    if keys:
        yield block()


def pack(node: np.ndarray, many: np.ndarray, keys: np.ndarray) -> bytes:
    """Part of a bucket: rows (node, number of keys) and the low 48 bits of their keys."""
    return b"".join([np.uint32(len(node)).tobytes(), node.astype(np.int64).tobytes(), many.astype(np.uint32).tobytes(), keys.view(np.uint8).reshape(-1, 8)[:, :6].tobytes()])


def unpack(part: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = int(np.frombuffer(part, np.uint32, 1)[0])
    node = np.frombuffer(part, np.int64, n, 4)
    many = np.frombuffer(part, np.uint32, n, 4 + 8 * n)
    low = np.frombuffer(part, np.uint8, offset=4 + 12 * n).reshape(-1, 6)
    keys = np.zeros((len(low), 8), np.uint8)
    keys[:, :6] = low
    return node, many, keys.view(np.uint64).ravel()


def _ends(keys: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, ascending, with their least and greatest node."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    if not len(start):
        return keys, least, most
    return keys[start], np.minimum.reduceat(least[order], start), np.maximum.reduceat(most[order], start)


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets of keys, ascending with them."""
    return ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def bucket_edges(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket begins in ascending keys, and their number."""
    least = [-(-(b << 32) // buckets) << 32 for b in range(buckets)]
    return np.append(np.searchsorted(keys, np.array(least, np.uint64)), len(keys))


def narrow(bucket: np.ndarray, low: np.ndarray) -> np.ndarray:
    """The key as buckets know it: 48 bits below the bucket's lowest 16. Keys that become equal by it share their pivots, which costs a comparison."""
    return (low & np.uint64((1 << 48) - 1)) | (bucket << np.uint64(48))


def _ends_only(keys: np.ndarray, row: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The entries of a block by key; of a key of three or more, only those of its least and its greatest node."""
    order = np.argsort(keys, kind="stable")
    keys, row = keys[order], row[order]
    del order
    start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    size = np.diff(start, append=len(keys))
    start, size = start[size > 2], size[size > 2]
    if not len(start):
        return keys, row
    first = np.cumsum(size) - size
    at = np.repeat(start - first, size) + np.arange(size.sum())
    own = node[row[at]]
    between = (own != np.repeat(np.minimum.reduceat(own, first), size)) & (own != np.repeat(np.maximum.reduceat(own, first), size))
    kept = np.ones(len(keys), bool)
    kept[at[between]] = False
    return keys[kept], row[kept]


def _parts(keys: np.ndarray, row: np.ndarray, node: np.ndarray, buckets: int) -> pa.RecordBatch:
    """(bucket, part) of entries in ascending order of their keys."""
    edge = bucket_edges(keys, buckets)
    some = np.flatnonzero(np.diff(edge))
    parts = []
    for b in some:
        here = slice(edge[b], edge[b + 1])
        by_row = np.argsort(row[here], kind="stable")
        which, count = np.unique(row[here][by_row], return_counts=True)
        parts.append(pack(node[which], count, keys[here][by_row]))
    return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(parts, pa.binary())], ["bucket", "part"])


def _dealt(rule: Rule, buckets: int):
    """The entries of each block in buckets of keys; of a key that many rows of a block hold, only the two that matter."""

    @K.tidy
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, row, node, _ in _incidence(batches, rule):
            keys, row = _ends_only(keys, row, node)
            out = _parts(keys, row, node, buckets)
            del keys, row, node
            yield out
            del out

    return emit


def _shared_keys(most_keys: int):
    """(key, pivot) of the keys that two or more nodes hold; pivot: the least of them.

    A task holds the distinct keys of its bucket, and entries only until there are
    ``most_keys`` of them: a key that very many rows hold takes one place.
    """

    @K.tidy
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = [(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))]
        held = 0

        def merged() -> tuple[np.ndarray, ...]:
            return _ends(*(np.concatenate(x) for x in zip(*waiting, strict=True)))

        for batch in batches:
            for b, part in zip(batch.column("bucket").to_pylist(), batch.column("part"), strict=True):
                node, many, low = unpack(part.as_buffer())
                own = np.repeat(node, many)
                waiting.append((narrow(np.uint64(b), low), own, own))
                held += len(low)
                if held >= most_keys:
                    waiting, held = [merged()], 0
        keys, least, most = merged()
        two = least != most
        yield pa.RecordBatch.from_arrays([pa.array(keys[two].view(np.int64)), pa.array(least[two])], ["key", "pivot"])

    return emit


def _met(rule: Rule, buckets: int, shared):
    """(key, node, meta) of the entries whose key may be shared."""

    @K.tidy
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, row, node, meta in _incidence(batches, rule):
            for lo in range(0, len(keys), 1 << 17):
                some, own = keys[lo : lo + (1 << 17)], row[lo : lo + (1 << 17)]
                some = narrow(bucket_of(some, buckets), some)
                hit = bit_filter.test(shared.value, some)
                yield pa.RecordBatch.from_arrays([pa.array(some[hit].view(np.int64)), pa.array(node[own[hit]]), pa.array(meta[own[hit]])], ["key", "node", "meta"])
            del keys, row, node, meta, some, own, hit

    return emit


def _worth(pivots: Column, need: Column) -> Column:
    """Pivots of (n, pivot) entries without those of the least n that add up to less than half of ``need``."""
    ascending = F.array_sort(pivots)
    room = F.floor((need - 1) / 2)
    state = F.struct(F.lit(0).cast("long").alias("sum"), F.array().cast("array<bigint>").alias("kept"))

    def step(acc: Column, x: Column) -> Column:
        total = acc["sum"] + x["n"]
        return F.struct(total.alias("sum"), F.when(total > room, F.concat(acc["kept"], F.array(x["pivot"]))).otherwise(acc["kept"]).alias("kept"))

    return F.aggregate(ascending, state, step)["kept"]


def buckets_for(rule: Rule, sets: int, elements: int) -> int:
    """Buckets by the number of keys that so many sets with so many elements in all have."""
    keys = 2 * (2 * sets + SPARE * rule.differing(2 * elements) * rule.den / rule.num)
    return max(BUCKETS, -int(-keys // BUCKET_KEYS))


def candidates(docs: DataFrame, rule: Rule, sets: int, elements: int) -> DataFrame:
    """(node, pivot) of rows that meet enough others, each pivot with itself too."""
    buckets = buckets_for(rule, sets, elements)
    parts = docs.mapInArrow(_dealt(rule, buckets), "bucket int, part binary").repartitionById(buckets, F.col("bucket"))
    keys = materialize(parts.mapInArrow(_shared_keys(BUCKET_KEYS), "key long, pivot long"))
    shared = docs.sparkSession.sparkContext.broadcast(bit_filter.build(keys, F.col("key")))
    met = docs.mapInArrow(_met(rule, buckets, shared), "key long, node long, meta long").join(keys, "key")
    met = met.groupBy("node", "meta", "pivot").agg(F.count("*").alias("n"))
    met = met.groupBy("node", "meta").agg(F.sum("n").alias("total"), F.collect_list(F.struct("n", "pivot")).alias("pivots")).withColumn("need", F.expr("meta div 2"))
    pairs = met.where("total >= need").select("node", F.explode(_worth(F.col("pivots"), F.col("need"))).alias("pivot"))
    return pairs.unionByName(pairs.select(F.col("pivot").alias("node"), "pivot")).distinct()


def _sets(rule: Rule, shared):
    """(node, n, set) of the sets whose node may be wanted, equal ones of a batch once."""

    @K.tidy
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[int, tuple[int, bytes]] = {}
            for _, own in shingle_sets(batch.column("text"), rule.words):
                if len(own) and (node := node_of(own)) not in found and bit_filter.test(shared.value, np.array([node]).view(np.uint64))[0]:
                    found[node] = (len(own), own.tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(found), pa.int64()), pa.array([n for n, _ in found.values()], pa.int64()), pa.array([s for _, s in found.values()], pa.binary())], ["node", "n", "own"]
            )

    return emit


def _apart(own: bytes, other: bytes) -> np.ndarray:
    """Elements of one set alone."""
    if own == other:
        return np.zeros(0, np.uint64)
    return np.setxor1d(np.frombuffer(own, np.uint64), np.frombuffer(other, np.uint64), assume_unique=True)


def _judge(rule: Rule):
    """f of each row against its pivot."""

    @K.tidy
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = [
                (rule.den - rule.num) * n - (rule.den + rule.num) * len(_apart(own, other))
                for n, own, other in zip(batch.column("n").to_pylist(), batch.column("own").to_pylist(), batch.column("other").to_pylist(), strict=True)
            ]
            yield pa.RecordBatch.from_arrays([batch.column("pivot"), batch.column("node"), pa.array(f, pa.int64())], ["pivot", "node", "f"])

    return emit


@K.tidy
def _differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        delta = [_apart(own, other).tobytes() for own, other in zip(batch.column("own").to_pylist(), batch.column("other").to_pylist(), strict=True)]
        names = ["pivot", "node", "f", "open", "parts"]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(delta, pa.binary())], [*names, "delta"])


def _forest(rule: Rule):
    """Spanning forest of the links of open rows inside one part of a pivot's rows, or between two parts."""

    def product(block: pa.Table) -> pa.Table:
        node, f, part = block.column("node").to_pylist(), block.column("f").to_numpy(), block.column("part").to_numpy()
        between = block.column("a")[0].as_py() != block.column("b")[0].as_py()
        sets = [np.frombuffer(d, np.uint64) for d in block.column("delta").to_pylist()]
        owner = np.repeat(np.arange(len(node)), [len(s) for s in sets])
        every = np.concatenate(sets)
        order = np.argsort(every, kind="stable")
        every, owner = every[order], owner[order]
        root: dict[int, int] = {}

        def top(v: int) -> int:
            while root.setdefault(v, v) != v:
                root[v] = root[root[v]]
                v = root[v]
            return v

        out: list[tuple[int, int]] = []
        for i in np.flatnonzero(block.column("open").to_numpy()).tolist():
            lo, hi = np.searchsorted(every, sets[i], "left"), np.searchsorted(every, sets[i], "right")
            many = hi - lo
            hits = owner[np.repeat(lo - np.cumsum(many) + many, many) + np.arange(many.sum())]
            common = np.bincount(hits, minlength=len(node))
            linked = f[i] + f + 2 * (rule.den + rule.num) * common >= 0
            if between:
                linked &= part != part[i]
            for j in np.flatnonzero(linked).tolist():
                x, y = top(node[i]), top(node[j])
                if x != y:
                    root[max(x, y)] = min(x, y)
                    out.append((node[i], node[j]))
        return pa.table({"u": pa.array([x for x, _ in out], pa.int64()), "v": pa.array([y for _, y in out], pa.int64())})

    return product


def links(docs: DataFrame, rule: Rule, sets: int, elements: int) -> DataFrame:
    """(u, v): links between sets (by node) that have the same connected components as all links. ``docs`` have so many sets with so many elements in all."""
    spark = docs.sparkSession
    docs = docs.select("text").where(F.col("text").isNotNull())
    pairs = materialize(candidates(docs, rule, sets, elements))
    shared = spark.sparkContext.broadcast(bit_filter.build(pairs, F.col("node")))
    sets = docs.mapInArrow(_sets(rule, shared), "node long, n long, own binary")
    wanted = sets.join(pairs.select("node").distinct(), "node", "left_semi")
    sets = materialize(wanted.groupBy("node").agg(F.first("n").alias("n"), F.first("own").alias("own")))
    pivots = sets.select(F.col("node").alias("pivot"), F.col("own").alias("other"))
    sizes = materialize(pairs.groupBy("pivot").agg(F.count("*").alias("n")))
    members = materialize(spread_join(pairs.join(sets, "node"), pivots, "pivot", "node", sizes, JOIN_ROWS).mapInArrow(_judge(rule), "pivot long, node long, f long"))

    best = members.groupBy("pivot").agg(F.max(F.struct("f", "node")).alias("best"), F.count("*").alias("members"))
    judged = spread_join(members, best, "pivot", "node", sizes, JOIN_ROWS).withColumn("open", F.col("f") + F.col("best.f") < 0)
    star = judged.where("not open and node <> best.node").select(F.col("node").alias("u"), F.col("best.node").alias("v"))
    groups = judged.where("open and members > 2").groupBy("pivot").agg(F.ceil(F.first("members") / PART_ROWS).alias("parts"))
    left = materialize(judged.where("members > 2 and node <> pivot").select("pivot", "node", "f", "open").join(groups, "pivot"))

    kinds = "pivot long, node long, f long, open boolean, parts long, delta binary"
    rows = spread_join(left.join(sets.select("node", "own"), "node"), pivots, "pivot", "node", sizes, JOIN_ROWS).mapInArrow(_differences, kinds)
    rows = rows.withColumn("part", F.pmod(F.xxhash64("node"), "parts")).withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    blocks = rows.select("pivot", "node", "f", "open", "part", "delta", F.least("part", "j").alias("a"), F.greatest("part", "j").alias("b"))
    return star.unionByName(blocks.groupBy("pivot", "a", "b").applyInArrow(_forest(rule), "u long, v long"))


def _classified(docs: DataFrame, rule: Rule) -> DataFrame:
    """(doc_id, n, node, label, component): size and identity of each row's set, its class, and the least doc_id there."""
    docs = docs.selectExpr("cast(doc_id as long) doc_id", "text")
    summary = materialize(docs.mapInArrow(_summary(rule), "doc_id long, n long, node long"))
    own = materialize(summary.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("least"), F.first("n").alias("n")))
    sets, elements = own.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    labelled = own.drop("n").join(components(links(docs, rule, sets, elements)), "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = labelled.groupBy("label").agg(F.min("least").alias("component"))
    return summary.join(labelled.join(least, "label").select("node", "label", "component"), "node", "left")


def classes(docs: DataFrame, rule: Rule | None = None) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): n_shingles, and component_id, the least doc_id that links reach."""
    component = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")))
    return _classified(docs, rule or Rule()).select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def _noded(rule: Rule, name: str):
    @K.tidy
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node = np.zeros(batch.num_rows, np.int64)
            for row, own in shingle_sets(batch.column("text"), rule.words):
                node[row] = node_of(own) if len(own) else 0
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(node, mask=node == 0)], [*batch.schema.names, name])

    return emit


def keep_one(docs: DataFrame, rule: Rule | None = None) -> DataFrame:
    """One row of each class, that of least doc_id, all columns unchanged.

    Classes are of rows, not of ids: an id may have rows in several. Of rows of a
    class with the same least id, the one with the least set identity, and then
    the least text, stays. Rows without doc_id or without words all stay.
    """
    rule = rule or Rule()
    known = materialize(_classified(docs, rule).where("n > 0 and doc_id is not null").groupBy("doc_id", "node").agg(F.first("label").alias("label"), F.count("*").alias("rows")))
    chosen = known.groupBy("label").agg(F.min(F.struct("doc_id", "node")).alias("one")).select("one.*")
    gone = materialize(known.join(chosen, ["doc_id", "node"], "left_anti").select("doc_id", "node"))
    ids = gone.select("doc_id").unionByName(known.where("rows > 1").select("doc_id")).distinct()
    key = F.col("doc_id").cast("long")
    clear, rest = bit_filter.divide(docs, key, ids)
    node, at, gone_id, gone_node = fresh(docs, "_node", "_at", "_gone_id", "_gone_node")
    schema = T.StructType([*docs.schema.fields, T.StructField(node, T.LongType())])
    rest = rest.mapInArrow(_noded(rule, node), schema).join(gone.toDF(gone_id, gone_node), (key == F.col(gone_id)) & (F.col(node) == F.col(gone_node)), "left_anti")
    first = F.row_number().over(Window.partitionBy("doc_id", node).orderBy("text"))
    loose = rest.where(F.col("doc_id").isNull() | F.col(node).isNull())
    tied = rest.where(F.col("doc_id").isNotNull() & F.col(node).isNotNull()).withColumn(at, first).where(F.col(at) == 1).drop(at)
    return clear.unionByName(loose.unionByName(tied).drop(node))
