"""Gated recurrent language model with a class-factored softmax, in numpy.

P(word | history) = P(group | h) * P(class | group, h) * P(word | class). h is the
state of a GRU over class ids; groups of classes keep the softmax at 2 * sqrt of
the number of classes. Frequent words are classes of their own; all others fall
into classes by their spelling (last bytes), so every word has one, seen or not.
In a spelling class, a word with count c has c / (N + n1 + 1) and the event of
any unseen word (n1 + 1) / (N + n1 + 1), where N is the class's tokens and n1 its
words seen once. So probabilities of all events sum to 1.

Counts (of words, spellings, classes and class pairs) cover all training
documents, and so does the network: an epoch takes every document once, in one of
its rounds; a round's documents are dealt by hash into shards of about ``SHARD``
tokens, each shard runs truncated backpropagation over all its tokens from the
same weights, and the weights are averaged by tokens.
Long texts take part whole: a shard is laid end to end and cut into parallel
streams, whose state starts at zero and is carried from window to window and from
block to block. Scoring runs over whole documents in windows, and the state is
carried from window to window until the document's end token.

Words with high counts (at most ``head`` of them) are broadcast; all other
words of a document get their counts by a join.

Null texts are empty: their one token is the end. Words are told apart by 64-bit
hashes. An empty table gives no rows; with no training row nothing is known, every
word has its spelling class's share for the unseen, and train_tokens is 0. Rows
without doc_id train and are scored like others; repeated rows count each time.
"""

from __future__ import annotations

import copy
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandflow.llm import textkernels as K
from strandflow.llm.tables import held_out, materialize

END = np.uint64(0x00E0D0C0B0A09080)
SIDE = 32
CLASSES = SIDE * SIDE
FREQUENT = 256  # the end token included
SPELLINGS = CLASSES - FREQUENT
FALLBACK = 64
HIDDEN = 16
WINDOW = 32
SHARD = 1 << 20  # tokens that one task learns from between two averages
BLOCK = 1 << 20  # tokens that lie in memory while it does
SLICES = 64  # parts of the weights that are averaged apart

PASSED = "doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, tail array<struct<h:long,s:short,n:int>>"


def _fast_sigmoid(x: np.ndarray) -> np.ndarray:
    return np.float32(1) / (np.float32(1) + np.exp(-x))


@dataclass
class Spelling:
    """Class of a word by its last three bytes if those are listed, else by its last byte."""

    suffixes: np.ndarray

    def __call__(self, words: K.Words) -> np.ndarray:
        last = words.suffixes(3)
        found = K.in_sorted(last, self.suffixes)
        return np.where(found >= 0, found + FALLBACK, (last & np.uint64(FALLBACK - 1)).astype(np.int64)).astype(np.int16)


def tokens(data: np.ndarray, at: np.ndarray, spelling: Spelling | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and spelling class (-1: end) of each token of a piece, and the range of each document's tokens."""
    words = K.words(data, at, K.NON_BLANK, K.LOWER)
    place = np.arange(len(words.starts)) + words.docs()
    n = len(words.starts) + len(at) - 1
    h, s = np.full(n, END, np.uint64), np.full(n, -1, np.int16)
    h[place] = words.hashes()
    if spelling is not None:
        s[place] = spelling(words)
    return h, s, words.first + np.arange(len(at))


class Network:
    """The recurrent part: scores class ids by class ids."""

    def __init__(self, unigram: np.ndarray, groups: np.ndarray, seed: int = 0, hidden: int = 32):
        """``groups``: SIDE x SIDE class ids."""
        rng = np.random.default_rng(seed)
        self.hidden, self.rooms = hidden, {}
        self.group = np.empty(groups.size, np.int64)
        self.member = np.empty(groups.size, np.int64)
        self.group[groups.ravel()] = np.repeat(np.arange(groups.shape[0]), groups.shape[1])
        self.member[groups.ravel()] = np.tile(np.arange(groups.shape[1]), groups.shape[0])
        share = (unigram[groups] + 0.5) / (unigram + 0.5).sum()
        f = np.float32
        self.p = {
            "x": (rng.normal(size=(groups.size, 3 * hidden)) * 0.2).astype(f),
            "u": (rng.normal(size=(hidden, 3 * hidden)) / np.sqrt(hidden)).astype(f),
            "a": np.zeros((hidden, groups.shape[0]), f),
            "a0": np.log(share.sum(1)).astype(f),
            "b": np.zeros((groups.shape[0], hidden, groups.shape[1]), f),
            "b0": np.log(share / share.sum(1, keepdims=True)).astype(f),
        }

    def step(self, h: np.ndarray, gx: np.ndarray) -> tuple[np.ndarray, ...]:
        """New state, gates and candidate; ``gx``: the inputs' part of the gates."""
        k = self.hidden
        gh = h @ self.p["u"]
        gates = _fast_sigmoid(gx[:, : 2 * k] + gh[:, : 2 * k])
        z, r = gates[:, :k], gates[:, k:]
        n = np.tanh(gx[:, 2 * k :] + r * gh[:, 2 * k :])
        return h + z * (n - h), z, r, n, gh[:, 2 * k :]

    def _softmax(self, logits: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log-probability of each target, exponentials, and their sums; logits are bounded, so that neither overflows."""
        np.clip(logits, -40, 40, out=logits)
        at = logits[np.arange(len(target)), target]
        np.exp(logits, out=logits)
        total = logits @ np.ones(logits.shape[1], logits.dtype)
        return at - np.log(total), logits, total

    def output(self, h: np.ndarray, target: np.ndarray, grads: dict | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Natural log-probability of each target class; with ``grads``, those of the summed loss and its gradient by h."""
        g, m = self.group[target], self.member[target]
        log_p, p, total = self._softmax(h @ self.p["a"] + self.p["a0"], g)
        dh = None
        if grads is not None:
            p /= total[:, None]
            p[np.arange(len(g)), g] -= 1
            grads["a"] += h.T @ p
            grads["a0"] += p.sum(0)
            dh = p @ self.p["a"].T
        order = np.argsort(g.astype(np.int16), kind="stable")
        edge = np.searchsorted(g[order], np.arange(self.p["b"].shape[0] + 1)).tolist()
        held, own = [k for k in range(len(edge) - 1) if edge[k] < edge[k + 1]], h[order]
        logits = np.empty((len(g), self.p["b"].shape[2]), h.dtype)
        for k in held:
            here = slice(edge[k], edge[k + 1])
            np.matmul(own[here], self.p["b"][k], out=logits[here])
            logits[here] += self.p["b0"][k]
        inner, p, total = self._softmax(logits, m[order])
        log_p[order] += inner
        if grads is not None:
            p /= total[:, None]
            p[np.arange(len(g)), m[order]] -= 1
            back = np.empty_like(own)
            for k in held:
                here = slice(edge[k], edge[k + 1])
                grads["b"][k] += own[here].T @ p[here]
                grads["b0"][k] += p[here].sum(0)
                np.matmul(p[here], self.p["b"][k].T, out=back[here])
            dh[order] += back
        return log_p, dh

    def window(self, h: np.ndarray, before: np.ndarray, target: np.ndarray, keep: np.ndarray) -> tuple[float, dict, np.ndarray]:
        """Loss, gradients and last state over (steps, streams); ``keep`` is 0 where a document starts."""
        steps, streams = before.shape
        k = self.hidden
        past, states = [], []
        gx = np.take(self.p["x"], before, axis=0, out=self._room(0, (steps, streams, 3 * k), h.dtype), mode="clip")
        for t in range(steps):
            h = h * keep[t][:, None]
            new = self.step(h, gx[t])
            past.append((h, *new[1:]))
            h = new[0]
            states.append(h)
        grads = {name: np.zeros_like(v) for name, v in self.p.items() if name not in ("x", "u")}
        log_p, d_out = self.output(np.concatenate(states), target.ravel(), grads)
        d_out = d_out.reshape(steps, streams, k)
        d_x, d_u = self._room(1, (2, steps, streams, 3 * k), h.dtype)
        dh = np.zeros_like(h)
        for t in reversed(range(steps)):
            dh = dh + d_out[t]
            h0, z, r, n, gn = past[t]
            d_n = dh * z * (1 - n * n)
            d_z = dh * (n - h0) * z * (1 - z)
            d_r = d_n * gn * r * (1 - r)
            d_x[t, :, :k], d_x[t, :, k : 2 * k], d_x[t, :, 2 * k :] = d_z, d_r, d_n
            d_h = d_u[t]
            d_h[:, : 2 * k] = d_x[t, :, : 2 * k]
            np.multiply(d_n, r, out=d_h[:, 2 * k :])
            dh = (dh * (1 - z) + d_h @ self.p["u"].T) * keep[t][:, None]
        grads["u"] = np.concatenate([x[0] for x in past]).T @ d_u.reshape(-1, 3 * k)
        order = np.argsort(before.ravel().astype(np.int16), kind="stable")
        own = before.ravel()[order]
        start = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        by_class = np.take(d_x.reshape(-1, 3 * k), order, axis=0, out=gx.reshape(-1, 3 * k), mode="clip")
        grads["x"] = (own[start], np.add.reduceat(by_class, start, axis=0))
        return -float(log_p.sum()), grads, h

    def _room(self, key: int, shape: tuple, kind: np.dtype) -> np.ndarray:
        """Scratch space that one window after another uses."""
        held = self.rooms.get(key)
        if held is None or held.shape != shape or held.dtype != kind:
            held = self.rooms[key] = np.empty(shape, kind)
        return held

    def __getstate__(self) -> dict:
        return {**self.__dict__, "rooms": {}}

    def flat(self) -> np.ndarray:
        return np.concatenate([v.ravel() for v in self.p.values()])

    def set_flat(self, w: np.ndarray) -> None:
        edges = np.cumsum([v.size for v in self.p.values()])[:-1]
        self.p = {k: part.reshape(v.shape).astype(np.float32) for (k, v), part in zip(self.p.items(), np.split(w, edges), strict=True)}

    def score(self, cls: np.ndarray, first: np.ndarray, end: int, window: int = WINDOW) -> np.ndarray:
        """Natural log-probability of each document's classes; ``first``: ranges of the documents."""
        n = np.diff(first)
        order = np.argsort(-n, kind="stable")
        start, left = first[:-1][order], n[order]
        out = np.zeros(len(n))
        if not len(n):
            return out
        h = np.zeros((len(n), self.hidden), np.float32)
        active = np.searchsorted(-left, -np.arange(left[0]), "left")  # documents longer than t
        for t0 in range(0, int(left[0]), window):
            states, targets, who = [], [], []
            for t in range(t0, min(t0 + window, int(left[0]))):
                a = int(active[t])
                here = start[:a] + t
                target = cls[here]
                before = cls[here - 1] if t else np.full(a, end)
                h = self.step(h[:a] if len(h) > a else h, self.p["x"][before])[0]
                states.append(h)
                targets.append(target)
                who.append(a)
            log_p, _ = self.output(np.concatenate(states), np.concatenate(targets).astype(np.int64))
            owner = np.concatenate([np.arange(a) for a in who])
            out[: who[0]] += np.bincount(owner, log_p, who[0])
        back = np.empty(len(n))
        back[order] = out
        return back


class Trainer:
    """Truncated backpropagation with Adam over a line of documents laid end to end, block after block."""

    def __init__(self, network: Network, end: int, streams: int = 192, steps: int = WINDOW, rate: float = 0.008):
        self.net, self.end, self.streams, self.steps, self.rate = network, end, streams, steps, rate
        self.m = {k: np.zeros_like(v) for k, v in network.p.items()}
        self.v = {k: np.zeros_like(v) for k, v in network.p.items()}
        self.last, self.h = end, np.zeros((1, network.hidden), np.float32)
        self.seen, self.loss = 0, 0.0

    def _walk(self, before: np.ndarray, target: np.ndarray, h: np.ndarray, progress, least: int) -> np.ndarray:
        p, m, v = self.net.p, self.m, self.v
        for t in range(0, len(before), self.steps):
            b, y = before[t : t + self.steps], target[t : t + self.steps]
            found, grads, h = self.net.window(h, b, y, (b != self.end).astype(np.float32))
            lr = self.rate * max(0.05, 1 - progress(self.seen))
            self.loss, self.seen = self.loss + found, self.seen + y.size
            scale = 1.0 / max(y.size, least)
            for name, g in grads.items():
                at, g = g if name == "x" else (slice(None), g)
                g = np.clip(g * scale, -0.05, 0.05)
                m[name][at] = 0.9 * m[name][at] + 0.1 * g
                v[name][at] = 0.99 * v[name][at] + 0.01 * g * g
                p[name][at] -= np.float32(lr) * m[name][at] / (np.sqrt(v[name][at]) + np.float32(1e-6))
        return h

    def feed(self, line: np.ndarray, progress) -> None:
        """Each class of the line is a target once. ``progress``: share of all training that is done, by tokens seen."""
        if not len(line):
            return
        line = line.astype(np.int64)
        before = np.concatenate([[self.last], line[:-1]])
        rows = len(line) // self.streams
        whole = rows * self.streams
        if rows:
            h = np.zeros((self.streams, self.net.hidden), np.float32)
            h[0] = self.h[0]
            h = self._walk(before[:whole].reshape(self.streams, rows).T, line[:whole].reshape(self.streams, rows).T, h, progress, 1)
            self.h = h[-1:]
        if whole < len(line):
            self.h = self._walk(before[whole:, None], line[whole:, None], self.h, progress, self.streams * self.steps)
        self.last = int(line[-1])


def similar_groups(pairs: np.ndarray) -> np.ndarray:
    """SIDE x SIDE class ids, from counts of class pairs: halved again and again along the first principal direction."""
    x = np.sqrt(np.concatenate([pairs, pairs.T], 1))
    x /= np.linalg.norm(x, axis=1, keepdims=True) + 1e-9
    basis = np.linalg.svd(x.T @ x, hermitian=True)[0][:, :12]
    x = x @ basis

    def halve(ids: np.ndarray) -> list[np.ndarray]:
        if len(ids) <= SIDE:
            return [ids]
        own = x[ids] - x[ids].mean(0)
        direction = np.linalg.svd(own, full_matrices=False)[2][0]
        ids = ids[np.argsort(own @ direction, kind="stable")]
        return halve(ids[: len(ids) // 2]) + halve(ids[len(ids) // 2 :])

    return np.stack(halve(np.arange(CLASSES)))


@dataclass
class Model:
    """All that scoring needs, of a size bounded by the parameters."""

    spelling: Spelling
    head: np.ndarray  # hashes, ascending
    head_count: np.ndarray
    frequent: np.ndarray  # hashes, ascending; class FREQUENT ids follow their order
    network: Network
    log_size: np.ndarray  # log10 (N + n1 + 1) by class
    total: int
    distinct: int

    @property
    def end(self) -> int:
        return int(np.searchsorted(self.frequent, END))

    def classes(self, h: np.ndarray, s: np.ndarray) -> np.ndarray:
        found = K.in_sorted(h, self.frequent)
        return np.where(found >= 0, found, s.astype(np.int64) + FREQUENT).astype(np.int16)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words by hash with their last three bytes (-1: end)."""
    for batch in batches:
        hashes, suffixes = [], []
        for lo, hi, data, at in K.pieces(batch.column("text")):
            words = K.words(data, at, K.NON_BLANK, K.LOWER)
            hashes += [words.hashes(), np.full(hi - lo, END)]
            suffixes += [words.suffixes(3).view(np.int64), np.full(hi - lo, -1, np.int64)]
        if hashes:
            h, at, n = np.unique(np.concatenate(hashes), return_index=True, return_counts=True)
            last = np.concatenate(suffixes)[at]
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(last), pa.array(n.astype(np.int64))], ["h", "suffix", "n"])


def _lines(shared):
    """The classes of each document, 16 bits each."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            lines: list[bytes] = []
            for lo, hi, data, at in K.pieces(batch.column("text")):
                h, s, own = tokens(data, at, model.spelling)
                c = model.classes(h, s)
                lines += [c[own[d] : own[d + 1]].tobytes() for d in range(hi - lo)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lines, pa.binary())], ["doc_id", "line"])

    return emit


def _line(column: pa.Array) -> np.ndarray:
    return K.string_bytes(column)[0].view(np.int16)


def _pairs(end: int):
    """Counts of neighbouring classes; a document follows an end."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(CLASSES * CLASSES, np.int64)
        for batch in batches:
            line = np.concatenate([[end], _line(batch.column("line"))]).astype(np.int64)
            found += np.bincount(line[:-1] * CLASSES + line[1:], minlength=CLASSES * CLASSES)
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(found[at])], ["pair", "n"])

    return emit


def _learn(shared, end: int, epoch: int, epochs: int, expected: float):
    """The weights after one shard, in slices."""

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network = copy.copy(shared.value)
        network.set_flat(network.flat())  # arrays of its own: other tasks of this worker read the broadcast
        trainer = Trainer(network, end)
        progress = lambda seen: (epoch + min(1.0, seen / expected)) / epochs
        parts, n = [], 0
        for batch in batches:
            line = _line(batch.column("line"))
            while n + len(line) >= BLOCK:
                trainer.feed(np.concatenate([*parts, line[: BLOCK - n]]), progress)
                line, parts, n = line[BLOCK - n :], [], 0
            parts, n = [*parts, line.copy()], n + len(line)
        trainer.feed(np.concatenate([*parts, np.zeros(0, np.int16)]), progress)
        if trainer.seen:
            slices = [w.tobytes() for w in np.array_split(network.flat(), SLICES)]
            shard = np.full(SLICES, TaskContext.get().partitionId())
            yield pa.RecordBatch.from_arrays(
                [pa.array(shard, pa.int32()), pa.array(np.arange(SLICES), pa.int32()), pa.array(np.full(SLICES, trainer.seen), pa.int64()), pa.array(slices, pa.binary())],
                ["shard", "slice", "seen", "w"],
            )

    return learn


def _average(rows: pa.Table) -> pa.Table:
    rows = rows.sort_by("shard")
    seen, total = rows.column("seen").to_numpy(), 0.0
    for n, w in zip(seen.tolist(), rows.column("w"), strict=True):
        total = total + n * np.frombuffer(w.as_py(), np.float32).astype(np.float64)
    mean = (total / seen.sum()).astype(np.float32)
    return pa.table({"slice": rows.column("slice")[:1], "seen": pa.array([int(seen.sum())], pa.int64()), "w": pa.array([mean.tobytes()], pa.binary())})


def train_network(network: Network, lines: DataFrame, end: int, total: int, epochs: int, rounds: int) -> int:
    """Fits the network to all of ``lines`` (doc_id, line), of ``total`` tokens: each epoch takes every line in one of its rounds. Returns the tokens of the last epoch."""
    context = lines.sparkSession.sparkContext
    shards = max(1, -(-total // (SHARD * rounds)))
    seen = 0
    for epoch in range(epochs):
        seen = 0
        keyed = lines.withColumn("_k", F.xxhash64("doc_id", "line", F.lit(epoch)))
        for turn in range(rounds):
            # other hashes: within a round and a shard, _k still has all values
            dealt = keyed.where(F.pmod(F.xxhash64("_k", F.lit(1)), F.lit(rounds)) == turn)
            dealt = dealt.repartitionById(shards, F.pmod(F.xxhash64("_k"), F.lit(shards)).cast("int")).sortWithinPartitions("_k", "doc_id", "line")
            shared = context.broadcast(network)
            learn = _learn(shared, end, epoch * rounds + turn, epochs * rounds, max(total / (shards * rounds), 1.0))
            learned = dealt.select("line").mapInArrow(learn, "shard int, slice int, seen long, w binary")
            mean = sorted(learned.groupBy("slice").applyInArrow(_average, "slice int, seen long, w binary").collect(), key=lambda r: r["slice"])
            if mean:
                network.set_flat(np.concatenate([np.frombuffer(r["w"], np.float32) for r in mean]))
                seen += mean[0]["seen"]
            shared.unpersist()
    return seen


def _pass(shared):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        norm = np.log10(model.total + model.distinct + 1)
        base_of = np.log10(model.head_count + 1) - norm
        word_of = np.log10(model.head_count)
        for batch in batches:
            n_docs = batch.num_rows
            cls, first = [], [np.zeros(1, np.int64)]
            base, word = np.zeros(n_docs), np.zeros(n_docs)
            known = np.zeros(n_docs, np.int64)
            tails: list[tuple] = []
            edges = [np.zeros(1, np.int64)]
            for lo, hi, data, at in K.pieces(batch.column("text")):
                h, s, own = tokens(data, at, model.spelling)
                c = model.classes(h, s)
                doc = np.repeat(np.arange(hi - lo), np.diff(own))
                found = K.in_sorted(h, model.head)
                listed = found >= 0
                known[lo:hi] = np.bincount(doc[listed], minlength=hi - lo)
                base[lo:hi] = np.bincount(doc[listed], base_of[found[listed]], hi - lo)
                spelled = c >= FREQUENT
                both = listed & spelled
                word[lo:hi] = np.bincount(doc[both], word_of[found[both]], hi - lo) - np.bincount(doc[spelled], model.log_size[c[spelled]], hi - lo)
                rest = np.flatnonzero(~listed)
                order = rest[np.lexsort((h[rest], doc[rest]))]
                new = np.ones(len(order), bool)
                new[1:] = (h[order[1:]] != h[order[:-1]]) | (doc[order[1:]] != doc[order[:-1]])
                start = np.flatnonzero(new)
                kept = order[start]
                tails.append((h[kept], s[kept], np.diff([*start, len(order)])))
                edges.append(np.searchsorted(doc[kept], np.arange(1, hi - lo + 1)) + edges[-1][-1])
                cls.append(c)
                first.append(own[1:] + first[-1][-1])
            if n_docs:
                first = np.concatenate(first)
                log_p = model.network.score(np.concatenate(cls), first, model.end) / np.log(10)
                th, ts, tn = (np.concatenate(x) for x in zip(*tails, strict=True))
                items = pa.StructArray.from_arrays([pa.array(th.view(np.int64)), pa.array(ts.astype(np.int16)), pa.array(tn.astype(np.int32))], ["h", "s", "n"])
                tail = pa.ListArray.from_arrays(pa.array(np.concatenate(edges).astype(np.int32)), items)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("held_out"), pa.array(np.diff(first)), pa.array(known), pa.array(base), pa.array(log_p + word), tail],
                    ["doc_id", "held_out", "n_tokens", "n_known", "base", "score", "tail"],
                )

    return score


def fit(docs: DataFrame, head: int, epochs: int, rounds: int) -> tuple[Model, DataFrame, np.ndarray]:
    """The model, the counts (h, s, n) of words beyond its head, and log10 of the weight of the unseen by spelling class."""
    spark = docs.sparkSession
    train = docs.where(~held_out(7, 2))
    found = materialize(train.select("text").mapInArrow(_count, "h long, suffix long, n long").groupBy("h", "suffix").agg(F.sum("n").alias("n")))
    common = found.where("suffix >= 0").groupBy("suffix").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "suffix").limit(SPELLINGS - FALLBACK)
    suffixes = np.array(sorted(r["suffix"] for r in common.collect()), np.int64)
    spelling = Spelling(suffixes.view(np.uint64))
    listed = spark.createDataFrame(list(zip(suffixes.tolist(), range(FALLBACK, FALLBACK + len(suffixes)), strict=True)), "suffix long, at int")
    s = F.when(F.col("suffix") < 0, -1).otherwise(F.coalesce("at", F.col("suffix").bitwiseAND(FALLBACK - 1)))
    level = F.floor(F.log2("n") * 8).cast("int")
    counts = found.join(F.broadcast(listed), "suffix", "left").select("h", s.cast("short").alias("s"), "n", level.alias("level"))
    sizes = counts.groupBy("level").agg(F.count("*").alias("words"), F.sum("n").alias("n")).collect()
    total, distinct = sum(r["n"] for r in sizes), sum(r["words"] for r in sizes)
    least, room = 1 << 20, head
    for r in sorted(sizes, key=lambda r: -r["level"]):
        if (room := room - r["words"]) < 0:
            break
        least = r["level"]
    known = counts.where(F.col("level") >= least).select("h", "s", "n").toArrow()
    h, s, n = (known.column(i).to_numpy() for i in range(3))
    h = h.view(np.uint64)
    order = np.argsort(h)
    h, s, n = h[order], s[order], n[order]
    top = np.lexsort((h, -n))
    top = top[h[top] != END][: FREQUENT - 1]
    frequent = np.sort(np.append(h[top], END))
    in_class, once, ends = np.zeros(CLASSES), np.zeros(CLASSES), 0
    for r in counts.groupBy("s").agg(F.sum("n").alias("n"), F.sum((F.col("n") == 1).cast("long")).alias("once")).collect():
        if r["s"] >= 0:
            in_class[r["s"] + FREQUENT], once[r["s"] + FREQUENT] = r["n"], r["once"]
        else:
            ends = r["n"]
    np.subtract.at(in_class, s[top].astype(np.int64) + FREQUENT, n[top])
    np.subtract.at(once, s[top].astype(np.int64) + FREQUENT, n[top] == 1)
    model = Model(spelling, h, n, frequent, None, np.log10(in_class + once + 1), total, distinct)

    unigram = in_class.copy()
    unigram[np.searchsorted(frequent, h[top])] = n[top]
    unigram[model.end] = ends
    lines = materialize(train.select("doc_id", "text").mapInArrow(_lines(spark.sparkContext.broadcast(model)), "doc_id long, line binary"))
    pairs = np.zeros(CLASSES * CLASSES)
    found = lines.select("line").mapInArrow(_pairs(model.end), "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    pairs[found.column("pair").to_numpy()] = found.column("n").to_numpy()
    model.network = Network(unigram, similar_groups(pairs.reshape(CLASSES, CLASSES)), hidden=HIDDEN)
    train_network(model.network, lines, model.end, total or 0, epochs, rounds)
    return model, counts.where(F.col("level") < least).select("h", "n"), np.log10(once + 1)[FREQUENT:]


def score_documents(docs: DataFrame, head: int = 1 << 19, epochs: int = 1, rounds: int = 3) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): token counts, unigram base score and model score, in log10."""
    docs = docs.selectExpr("cast(doc_id as long) doc_id", "text")
    model, rare, unseen = fit(docs, head, epochs, rounds)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    passed = docs.select("doc_id", held_out(7, 2).alias("held_out"), "text").mapInArrow(_pass(shared), PASSED)
    passed = materialize(passed.withColumn("uid", F.monotonically_increasing_id()))

    norm = float(np.log10(model.total + model.distinct + 1))
    tail = passed.select("uid", F.explode("tail").alias("t")).select("uid", "t.h", "t.s", F.col("t.n").alias("times"))
    tail = tail.join(rare, "h", "left")
    alone = F.element_at(F.array(*(F.lit(float(x)) for x in unseen)), F.greatest(F.col("s").cast("int"), F.lit(0)) + 1)
    tail = tail.groupBy("uid").agg(
        F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("t_known"),
        F.sum(F.col("times") * (F.log10(F.coalesce(F.col("n"), F.lit(0)) + 1) - F.lit(norm))).alias("t_base"),
        F.sum(F.col("times") * F.when(F.col("n").isNotNull(), F.log10("n")).when(F.col("s") >= 0, alone).otherwise(0.0)).alias("t_score"),
    )
    out = passed.drop("tail").join(tail, "uid", "left")
    add = lambda a, b: F.col(a) + F.coalesce(F.col(b), F.lit(0))
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        add("n_known", "t_known").cast("long").alias("n_known"),
        F.lit(model.total).cast("long").alias("train_tokens"),
        add("base", "t_base").alias("base_score"),
        add("score", "t_score").alias("score"),
    )
