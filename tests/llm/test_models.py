"""Trained operators: held-out accuracy, brute-force counts, gradients, and awkward rows."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from strandflow.llm import gated_lm, language_id, quality, toxicity
from strandflow.llm.boosting import BoostedTrees, Isotonic, sigmoid
from strandflow.llm.tables import labelled_sample
from tests.llm.conftest import corpus

LABELS = "doc_id long, quality int, toxic int, text string"


def held(i: int, mod: int, rest: int) -> bool:
    return zlib.crc32(str(i).encode()) % mod == rest


def syllables(rng: random.Random, kinds: str, n: int) -> str:
    return " ".join("".join(rng.choice(kinds.split()) for _ in range(rng.choice([1, 2, 2, 3]))) for _ in range(n))


EN, FR = "the an ing er ou th re st ly", "la que é ment ou eau ê oi re"


@pytest.fixture(scope="module")
def labelled(make, spark):
    rng = random.Random(11)
    rows, labels = [], []
    for i in range(400):
        french = i % 3 == 0
        text = syllables(rng, FR if french else EN, rng.randrange(20, 120)).split()
        toxic, bad = i % 5 == 1, i % 4 == 2
        if toxic:
            for _ in range(4):
                text.insert(rng.randrange(len(text)), rng.choice(["you idiot", "zorblax" + rng.choice("abc"), "st*pid"]))
        if bad:
            text = [w.upper() + "!!" for w in text]
        rows.append((i, " ".join(text), "fr" if french else "en", "s"))
        labels.append((i, int(not bad), int(toxic), "clash"))
    rows += [(1000, None, "en", "s"), (1001, "", None, None), (1002, "12 34 !!", "en", "s"), (1003, "long " * 20000, None, "s"), (3, rows[3][1], "fr", "s")]
    labels += [(1, None, None, None), (5000, 1, 1, None)]
    return make(rows), spark.createDataFrame(labels, LABELS), rows, labels


def accuracy(df, want: dict, column: str = "predicted", only_held: bool = True) -> float:
    rows = [r for r in df.collect() if r["doc_id"] in want and (r["held_out"] or not only_held)]
    return np.mean([r[column] == want[r["doc_id"]] for r in rows])


def test_quality(labelled):
    docs, labels, rows, known = labelled
    got = quality.score_quality(docs, labels).cache()
    assert got.count() == len(rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) and r["held_out"] == held(r["doc_id"], 5, 0) for r in got.collect())
    assert accuracy(got, {i: q for i, q, *_ in known if q is not None}) > 0.95
    assert quality.score_quality(docs.limit(0), labels).count() == 0
    assert quality.score_quality(docs, labels.limit(0)).select("score").distinct().count() == 1


def test_toxicity(labelled):
    docs, labels, rows, known = labelled
    got = toxicity.score_toxicity(docs, labels).cache()
    assert got.count() == len(rows)
    assert accuracy(got, {i: t for i, _, t, _ in known if t is not None}) > 0.9
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in got.collect() if r["predicted"] == 0}
    assert toxicity.score_toxicity(docs, labels.limit(0)).where("score > 0").count() == 0
    for label in (0, 1):
        only = labels.where(f"toxic = {label} and quality = {label}")
        for operator, frame in ((toxicity.score_toxicity, docs), (quality.score_quality, docs)):
            assert {r["score"] for r in operator(frame, only).collect()} == {float(label)}
    assert toxicity.score_toxicity(docs.limit(0), labels).count() == 0


def test_samples_are_bounded(spark, make):
    """One id under very many rows, one text under very many ids, rows without id."""
    texts = [(7, f"own text {i}", None, None) for i in range(3000)] + [(100 + i, "one text", None, None) for i in range(500)] + [(None, f"nameless {i}", None, None) for i in range(500)]
    texts += [(1000 + i, f"text {i}", None, None) for i in range(60)]
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i, *_ in texts if i] * 2 + [(None, 1, 1)], "doc_id long, quality int, toxic int")
    rows = labelled_sample(make(texts), labels, "toxic", 5, 0, 10, 1 << 15)
    assert 0 < len(rows) <= 20 and len(set(rows)) == len(rows)
    assert max(sum(y == k for _, y in rows) for k in (0, 1)) <= 10
    assert labelled_sample(make(texts), labels, "toxic", 5, 0, 10, 3) == []


def plain_features(text: str, strong: set[str]) -> dict:
    """Some features of toxicity by plain loops over characters."""
    words, tokens = re.findall(r"[^\W\d_]+", text.lower()), text.split()
    masked = 0
    for t in tokens:
        places = [i for i, c in enumerate(t) if c.isalpha()]
        inside = t[places[0] : places[-1]] if places else ""
        masked += any(c in "*#$%&013457@" for c in inside) and "/" not in t and not ("@" in t and "." in t)
    return {"hits": sum(w in strong for w in words), "capitals": sum(c.isupper() for c in text) / max(1, len(text)), "masked": masked / max(1, len(tokens)), "words": math.log1p(len(words))}


def test_toxicity_features():
    import pyarrow as pa

    from strandflow.llm import textkernels as K

    texts = ["You IDIOT! id1ot", "", "¿Qué? ÉTÉ “quoted” idiot", "word2vec a@b.org http://x.y/?a&b sh**t *** b*d", "ДУРАК дурак idiots", "1dea idea1"]
    words = toxicity._lines(*K.string_bytes(pa.array(["idiot дурак"])))[2].hashes()
    lexicon = toxicity.Lexicon(np.sort(words), np.full(2, 5.0))
    found = toxicity.features(*K.string_bytes(pa.array(texts)), lexicon)
    assert found.shape == (len(texts), toxicity.N_FEATURES)
    for row, text in zip(found, texts, strict=True):
        want = plain_features(text, {"idiot", "дурак"})
        assert (row[0], row[8], row[11], row[12]) == pytest.approx((want["hits"], want["capitals"], want["masked"], want["words"]))


def test_trees_and_isotonic_by_replay():
    """Predictions by walking each tree in plain Python; the isotonic fit against all weighted averages."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 3))
    y = (x[:, 0] + x[:, 1] > 0).astype(float)
    trees = BoostedTrees(rounds=8).fit(x, y)
    for row, raw in zip(x[:50], trees.raw(x[:50]), strict=True):
        total = trees.base
        for feature, cut, leaf in zip(trees.feature, trees.cut, trees.leaf, strict=True):
            node = 0
            for f, c in zip(feature, cut, strict=True):
                node = 2 * node + int(row[f[node]] > c[node])
            total += leaf[node]
        assert total == pytest.approx(raw)
    z = np.sort(rng.uniform(size=40))
    labels = (rng.uniform(size=40) < z).astype(float)
    fit = Isotonic().fit(z, labels)
    # min-max formula of the isotonic regression
    want = [max(min(labels[a : b + 1].mean() for b in range(i, 40)) for a in range(i + 1)) for i in range(40)]
    pools = [want.index(v) for v in dict.fromkeys(want)] + [40]
    means = [(labels[a:b].sum() + 0.5) / (b - a + 1) for a, b in zip(pools, pools[1:], strict=False)]
    assert len(fit.y) <= len(means) + 1 and (np.diff(fit.y) >= 0).all()
    assert fit.y == pytest.approx(np.maximum.accumulate(means)) if len(fit.y) == len(means) else True




def test_language(labelled):
    docs, _, rows, _ = labelled
    got = language_id.identify_language(docs).cache()
    assert got.count() == len(rows)
    assert accuracy(got.where("doc_id < 1000"), {i: lang for i, _, lang, _ in rows if i < 1000}, "lang_pred") > 0.98
    odd = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in got.where("doc_id between 1000 and 1002").collect()}
    assert odd == {i: ("und", 0.0) for i in (1000, 1001, 1002)}
    assert language_id.identify_language(docs.limit(0)).count() == 0


def plain_grams(text: str, bits: int):
    """Buckets of the 1, 2 and 3-grams of a text, by plain integers."""
    points = [ord(c.lower()) if len(c.lower()) == 1 else ord(c) for c in text]
    for n in (1, 2, 3):
        for i in range(len(points) - n + 1):
            h = 0
            for m in range(1, n + 1):
                h = (h * 0x01000193 + (points[i + m - 1] + m) * 0x9E3779B1) & 0xFFFFFFFF
            yield ((h ^ (h >> 15)) * 0x85EBCA6B & 0xFFFFFFFF) >> (32 - bits)


def test_language_by_plain_naive_bayes(make):
    rng = random.Random(21)
    some = ["Ärger ÉTÉ", "", "b", "ab cd é", "ДА нет", "ԱՐԵՒ արեւ", None, "漢字", "𐐀𐐨", "7 !", "x" * 3000]
    rows = [(i, some[i % 11] if i % 3 == 0 else syllables(rng, FR if i % 2 else EN, 9), ("fr", "en", "ru", None)[i % 4], None) for i in range(90)]
    rows.append((None, "no id", "en", None))
    got = {r["doc_id"]: r for r in language_id.identify_language(make(rows), bits=10).collect()}
    assert len(got) == len(rows)
    counts: dict[str, Counter] = {}
    for i, text, lang, _ in rows:
        if text is not None and lang is not None and (i is None or not held(i, 4, 2)):
            counts.setdefault(lang, Counter()).update(plain_grams(text, 10))
    counts = {k: c for k, c in counts.items() if c}
    for i, text, *_ in rows:
        if not any(c.isalpha() for c in text or ""):
            assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0)
            continue
        found = list(plain_grams(text, 10))
        total = {k: sum(math.log((c[g] + 0.5) / (sum(c.values()) + 512)) for g in found) * min(1, 60 / len(found)) for k, c in counts.items()}
        top = max(total.values())
        p = 1 / sum(math.exp(v - top) for v in total.values())
        assert got[i]["score"] == pytest.approx(p, abs=1e-3)
        assert total[got[i]["lang_pred"]] == pytest.approx(top, abs=1e-3)
    with pytest.raises(ValueError):
        language_id.identify_language(make(rows), most_languages=2)


def test_boosting_and_isotonic():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1500, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    trees = BoostedTrees().fit(x[:1000], y[:1000])
    assert ((trees.raw(x[1000:]) > 0) == y[1000:]).mean() > 0.93
    z = rng.uniform(0, 1, 3000)
    fit = Isotonic().fit(z, (rng.uniform(size=3000) < z**2).astype(float))
    at = np.linspace(0.1, 0.9, 9)
    assert np.abs(fit(at) - at**2).max() < 0.1 and (np.diff(fit(at)) >= 0).all()
    assert sigmoid(np.array([0.0]))[0] == 0.5


def test_gru_gradients():
    rng = np.random.default_rng(2)
    groups = np.arange(16).reshape(4, 4)
    net = gated_lm.Network(np.ones(16), groups, hidden=5)
    net.p = {k: v.astype(np.float64) + 0.1 * rng.normal(size=v.shape) for k, v in net.p.items()}
    before, target = rng.integers(0, 16, (4, 3)), rng.integers(0, 16, (4, 3))
    keep = np.ones((4, 3))
    keep[2, 1] = 0
    h = rng.normal(size=(3, 5))
    _, grads, _ = net.window(h, before, target, keep)
    full = np.zeros_like(net.p["x"])
    full[grads["x"][0]] = grads["x"][1]
    grads["x"] = full
    for name, value in net.p.items():
        for _ in range(4):
            at = tuple(rng.integers(0, s) for s in value.shape)
            value[at] += 1e-5
            up = net.window(h, before, target, keep)[0]
            value[at] -= 2e-5
            down = net.window(h, before, target, keep)[0]
            value[at] += 1e-5
            assert grads[name][at] == pytest.approx((up - down) / 2e-5, rel=2e-3, abs=2e-4)


def test_state_is_carried_across_windows():
    rng = np.random.default_rng(3)
    net = gated_lm.Network(np.ones(1024), np.arange(1024).reshape(32, 32))
    docs = [rng.integers(0, 1024, n).astype(np.int16) for n in (1, 70, 3, 200)]
    first = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    whole = net.score(np.concatenate(docs), first, 7, window=1000)
    cut = net.score(np.concatenate(docs), first, 7, window=9)
    alone = [net.score(d, np.array([0, len(d)]), 7)[0] for d in docs]
    assert cut == pytest.approx(whole, rel=1e-4) and cut == pytest.approx(alone, rel=1e-4)


def test_class_probabilities_sum_to_one():
    net = gated_lm.Network(np.ones(1024), np.arange(1024).reshape(32, 32))
    h = np.random.default_rng(4).normal(size=(1, 32)).astype(np.float32)
    log_p, _ = net.output(np.repeat(h, 1024, 0), np.arange(1024))
    assert np.exp(log_p).sum() == pytest.approx(1, abs=1e-4)


@pytest.mark.parametrize("head", [1 << 18, 40])
def test_lm_scores(make, head):
    rng = random.Random(8)
    rows = [(2000 + i, syllables(rng, EN if i % 2 else FR, 150), None, None) for i in range(150)] + corpus(3)
    got = {r["doc_id"]: r for r in gated_lm.score_documents(make(rows), head=head, epochs=3).collect()}
    assert len(got) == len(rows)
    tok = lambda t: [*re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower()), None]
    counts = Counter(w for i, t, *_ in rows if not held(i, 7, 2) for w in tok(t))
    n, v = sum(counts.values()), len(counts)
    for i, t, *_ in rows:
        r = got[i]
        assert r["held_out"] == held(i, 7, 2) and r["train_tokens"] == n
        assert (r["n_tokens"], r["n_known"]) == (len(tok(t)), sum(w in counts for w in tok(t)))
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tok(t)), rel=1e-9)
        assert r["score"] < 0
    out = [r for r in got.values() if r["held_out"] and r["doc_id"] >= 2000]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)


def test_lm_empty(make):
    df = make(corpus(1)[:3])
    assert gated_lm.score_documents(df.limit(0)).count() == 0
    assert gated_lm.score_documents(df, epochs=1).count() == 3
    unseen = [i for i in range(300) if held(i, 7, 2)][:4]
    seen = [i for i in range(300) if not held(i, 7, 2)][:4]
    for ids in (unseen, seen):
        got = gated_lm.score_documents(make([*((i, "One two three", None, None) for i in ids), (ids[0], None, None, None)])).collect()
        assert len(got) == 5 and all(np.isfinite([r["score"], r["base_score"]]).all() and r["held_out"] == (ids is unseen) for r in got)
        assert {(r["n_tokens"], r["n_known"], r["train_tokens"]) for r in got} == ({(4, 0, 0), (1, 0, 0)} if ids is unseen else {(4, 4, 17), (1, 1, 17)})


def test_lm_learns_from_long_texts(make):
    """All training texts are longer than 32 KB; none may be left out of the network, the spellings and the class counts."""
    rng = random.Random(11)
    rows = [(i, syllables(rng, EN if i % 2 else FR, 9000), None, None) for i in range(16)]
    assert min(len(t) for _, t, *_ in rows) > 1 << 15
    got = {r["doc_id"]: r for r in gated_lm.score_documents(make(rows)).collect()}
    out = [r for r in got.values() if r["held_out"]]
    assert out and sum(r["score"] for r in out) > sum(r["base_score"] for r in out)


def test_lm_epoch_covers_all_tokens(spark, monkeypatch):
    monkeypatch.setattr(gated_lm, "SHARD", 700)
    rng = np.random.default_rng(3)
    docs = [(i % 9 or None, np.append(rng.integers(0, 1000, n), 7).astype(np.int16).tobytes()) for i, n in enumerate(rng.integers(0, 400, 40))]
    total = sum(len(line) // 2 for _, line in docs)
    lines = spark.createDataFrame(docs, "doc_id long, line binary").repartition(3)
    fitted = []
    for _ in range(2):
        network = gated_lm.Network(np.ones(1024), np.arange(1024).reshape(32, 32))
        before = network.flat()
        assert gated_lm.train_network(network, lines, 7, total, 2, 2) == total
        assert np.abs(network.flat() - before).max() > 0
        fitted.append(network.flat())
    assert (fitted[0] == fitted[1]).all()


@pytest.mark.parametrize("n", [1, 191, 192, 1000])
def test_trainer_takes_each_token_once(n):
    network = gated_lm.Network(np.ones(1024), np.arange(1024).reshape(32, 32))
    trainer = gated_lm.Trainer(network, 7)
    for line in (np.arange(n) % 1024, np.zeros(0), np.arange(n) % 1024):
        trainer.feed(line.astype(np.int16), lambda seen: 0.0)
    assert trainer.seen == 2 * n and trainer.last == n - 1
