"""Stream operators against golden inputs and a record-at-a-time simulator."""

from __future__ import annotations

import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from strandflow import functions as fn
from strandflow import operators as op
from strandflow import queries, sinks, sources
from strandflow.operators import keyed, ordered, parts


@pytest.fixture(params=[1, 9], ids=["one range", "many ranges"])
def ranges(request, monkeypatch):
    monkeypatch.setattr(ordered, "ranges_of", lambda spark: request.param)


def stream(spark, values, kind="string"):
    return sources.elements(spark, values, kind)


WORDS = "hello this is xyz hello this is sparta sparta is leonida".split()


def test_word_count(spark, ranges):
    got = op.running_fold(stream(spark, WORDS), {"n": ("count", F.lit(1))}, ("value",))
    want, seen = [], {}
    for i, w in enumerate(WORDS):
        seen[w] = seen.get(w, 0) + 1
        want.append((i, w, seen[w]))
    assert sorted((r["seq"], r["value"], r["n"]) for r in got.collect()) == want
    assert got.columns == ["seq", "value", "n"]


def counted_parts(rows):
    """By order (null last), then place: (order, place, part, n)."""
    parts = [(o, i, w) for o, t in rows if t is not None for i, w in enumerate(t.split(" "))]
    out, seen = [], {}
    for o, i, w in sorted(parts, key=lambda p: (p[0] is None, p[0] or 0, p[1])):
        seen[w] = seen.get(w, 0) + 1
        out.append((o, i, w, seen[w]))
    return sorted(out, key=str)


@pytest.mark.parametrize("piece", [1, 40, 1 << 22])
def test_running_parts(spark, ranges, piece):
    """Random texts with null, repeated and far orders, null and empty texts, empty parts; in pieces of any size and in batches of one row."""
    rng = random.Random(7)
    texts = [" ".join(rng.choice(["a", "b", "", "é", "word", str(rng.randrange(40))]) for _ in range(rng.randrange(1, 12))) for _ in range(90)]
    rows = [(rng.choice([None, rng.randrange(-20, 20), rng.randrange(1000), 1 << 62]), t) for t in [*texts, None, "", " ", "a  a "]]

    def patched(emit):
        def run(batches):
            parts.PIECE, parts.PARTS = piece, max(piece, 3)
            single = (b.slice(i, 1) for b in batches for i in range(b.num_rows))
            yield from emit(single)

        return run

    with pytest.MonkeyPatch.context() as m:
        for name in ("_totals", "_running"):
            m.setattr(parts, name, lambda *a, emit=getattr(parts, name): patched(emit(*a)))
        got = op.running_parts(spark.createDataFrame(rows, "o long, t string").repartition(3), "t", "o")
    assert got.columns == ["o", "place", "value", "n"]
    assert sorted(map(tuple, got.collect()), key=str) == counted_parts(rows)


def test_running_parts_cut_anywhere(spark):
    rows = [(i % 7, f"x {i} x") for i in range(30)]
    df = spark.createDataFrame(rows, "o long, t string")
    for cuts in [(), (0.5,), (-5.0, 2.0, 2.5, 3.0, 99.0)]:
        assert sorted(map(tuple, op.running_parts(df, "t", "o", cuts=op.Cuts(cuts)).collect()), key=str) == counted_parts(rows)
    assert op.running_parts(df.limit(0), "t", "o").count() == 0


def test_word_count_shuffles_texts(spark, tmp_path):
    """Words aren't rows before they are counted; words beyond the millionth of a text, and texts without id, come in their turn as in SQL."""
    rows = [(1, "a " * 1_000_001 + "b"), (2, "a"), (None, "a")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.wordcount_running(spark, str(tmp_path))
    assert "Generate" not in got._jdf.queryExecution().executedPlan().toString()
    last = got.where("word = 'a' and (seq is null or seq >= 2000000)").collect()
    assert sorted((r["n"], r["seq"]) for r in last) == [(1_000_000, 2_000_000), (1_000_001, 2_000_001), (1_000_002, 2_000_001), (1_000_003, None)]


def test_running_sum(spark, ranges):
    got = op.running_fold(stream(spark, range(5), "long"), {"total": ("sum", F.col("value"))})
    assert [r["total"] for r in got.orderBy("seq").collect()] == [0, 1, 3, 6, 10]


def test_running_folds_on_random_rows(spark, ranges):
    rng = random.Random(1)
    rows = [(i, rng.choice(["a", "b", None]), rng.choice([None, rng.randrange(-50, 50)])) for i in rng.sample(range(1000), 60)]
    df = spark.createDataFrame(rows, "seq long, k string, v long")
    got = op.running(df, "seq", {"s": ("sum", F.col("v")), "lo": ("min", F.col("v")), "hi": ("max", F.col("v")), "c": ("count", F.col("v"))}, ("k",))
    state: dict = {}
    want = {}
    for i, k, v in sorted(rows):
        if v is not None:
            state.setdefault(k, []).append(v)
        s = state.get(k)
        want[i] = (sum(s), min(s), max(s), len(s)) if s else (None, None, None, 0)
    assert {r["seq"]: (r["s"], r["lo"], r["hi"], r["c"]) for r in got.collect()} == want
    assert op.running(df.limit(0), "seq", {"s": ("sum", F.col("v"))}).count() == 0


def test_running_folds_leave_columns_and_types(spark, ranges):
    df = spark.createDataFrame([(i, i % 2, 5, 6, 7) for i in range(12)], "seq long, k long, _range int, _own int, _V0 int")
    for keys in ((), ("k",)):
        got = op.running(df, "seq", {"s": ("sum", F.expr("cast(seq as decimal(10, 2))")), "k2": ("max", F.col("k"))}, keys)
        assert got.columns == [*df.columns, "s", "k2"]
        assert got.schema["s"].dataType.simpleString() == "decimal(20,2)"
        want = {i: sum(j for j in range(i + 1) if not keys or j % 2 == i % 2) for i in range(12)}
        assert {r["seq"]: r["s"] for r in got.collect()} == want
        assert {tuple(r)[2:5] for r in got.collect()} == {(5, 6, 7)}


def test_flat_map_keeps_order(spark):
    got = op.flat_map(stream(spark, [1], "long"), F.transform(F.sequence(F.lit(1), F.lit(4)), lambda k: k * F.col("value")), place="i")
    assert [r["value"] for r in got.orderBy("i").collect()] == [1, 2, 3, 4]


def test_naive_map(spark):
    df = sources.ElementsBuilder().add(1, 2, 3, 4, 5).stream(spark)
    assert sorted(r["v"] for r in op.map_values(df, v=F.col("value") * 2).collect()) == [2, 4, 6, 8, 10]


def test_errors_reach_the_caller(spark):
    with pytest.raises(PySparkException):
        stream(spark, ["x"]).select(F.raise_error(F.lit("broken"))).collect()


def test_align(spark, ranges):
    df = stream(spark, ["hello", "this", "is", "xyz"])
    upper, size = op.fan_out(df, lambda d: d.withColumn("value", F.upper("value")), lambda d: d.withColumn("value", fn.byte_length(F.col("value"))))
    pairs = op.align(upper, size.where("seq < 3"))
    assert sorted(f"{r['left']['value']}: {r['right']['value']}" for r in pairs.collect()) == ["HELLO: 5", "IS: 2", "THIS: 4"]


def test_partitions(spark, ranges):
    df = stream(spark, range(1, 11), "int")
    got = op.with_partition(df, F.col("value"), 2).orderBy("seq").collect()
    assert [r["value"] for r in got if r["_partition"] == 0] == [2, 4, 6, 8, 10]
    dealt = op.round_robin(df, 3).orderBy("seq").collect()
    assert [r["_partition"] for r in dealt] == [i % 3 for i in range(10)]


def test_fnv(spark):
    known = {"": 14695981039346656037, "a": 0xAF63DC4C8601EC8C, "foobar": 0x85944171F73967E8}
    got = spark.createDataFrame([(k,) for k in [*known, None, "é" * 50]], "s string").select("s", fn.fnv1a64(F.col("s")).alias("h")).collect()
    assert {r["s"]: int(r["h"]) for r in got if r["s"] in known} == known
    assert [r["h"] for r in got if r["s"] is None] == [None]
    h = 14695981039346656037
    for b in ("é" * 50).encode():
        h = (h ^ b) * 1099511628211 % 2**64
    assert [int(r["h"]) for r in got if r["s"] and r["s"][0] == "é"] == [h]


def test_merge_tags_inputs(spark):
    got = op.merge(*(stream(spark, [i], "int") for i in range(10))).collect()
    assert sorted((r["value"], r["_source"]) for r in got) == [(i, i) for i in range(10)]
    one = stream(spark, [7], "int")
    assert sorted(r["_source"] for r in op.merge(one, one).collect()) == [0, 1]


def test_dedupe_and_first_rows(spark):
    df = stream(spark, WORDS)
    assert sorted((r["seq"], r["value"]) for r in op.dedupe_first(df, ("value",)).collect()) == [(0, "hello"), (1, "this"), (2, "is"), (3, "xyz"), (7, "sparta"), (10, "leonida")]
    assert sorted(r["seq"] for r in keyed.first_rows(df, ("value",), 2).collect()) == [0, 1, 2, 3, 4, 5, 6, 7, 8, 10]


def test_opaque_fold_has_state_of_its_own(spark):
    def step(state, row):
        state.append(row["value"])
        return state, [(row["value"], len(state))]

    got = op.fold_opaque(stream(spark, WORDS), ("value",), [], step, "value string, n long").collect()
    assert sorted((r["value"], r["n"]) for r in got if r["value"] == "is") == [("is", 1), ("is", 2), ("is", 3)]


def test_salted_fold(spark):
    got = keyed.salted_fold(stream(spark, WORDS), ("value",), 4, {"p": F.count("*")}, {"n": F.sum("p")}).collect()
    assert {r["value"]: r["n"] for r in got} == {w: WORDS.count(w) for w in WORDS}


# Watermarks


def test_watermark_of_one_source(spark, ranges):
    rows = list(enumerate([(0, 0), (1, 0), (1, 1), (5, 3), (5, 0), (5, 4)]))
    df = spark.createDataFrame([(i, ts, wm) for i, (ts, wm) in rows], "seq long, ts long, wm long")
    got = op.watermark(op.assign_time(df, F.col("ts"), F.col("wm"))).orderBy("seq").collect()
    assert [r["_wm"] for r in got] == [0, 0, 1, 3, 3, 4]


def test_watermark_of_many_sources(spark, ranges):
    rows = [(0, 0, 0, 0), (1, 1, 10, 5), (2, 2, 8, 3), (3, 0, 11, 10), (4, 1, 5, 0), (5, 2, 9, 6)]
    df = spark.createDataFrame(rows, "seq long, source int, ts long, wm long")
    got = op.merged_watermark(op.assign_time(df, F.col("ts"), F.col("wm")), "source", [0, 1, 2]).orderBy("seq").collect()
    assert [r["_wm"] for r in got] == [0, 0, 0, 3, 3, 5]


# Windows


@pytest.mark.parametrize(
    ("size", "slide", "want"),
    [
        (5, 1, {0: [0], 1: [0, 1], 10: [6, 7, 8, 9, 10], 7: [3, 4, 5, 6, 7], -1: []}),
        (3, 3, {0: [0], 1: [0], 4: [3], 7: [6]}),
        (5, 6, {0: [0], 4: [0], 5: [], 6: [6], 42: [42], 43: [42], 46: [42], 50: [48], -6: []}),
        (5, 2, {0: [0], 1: [0], 2: [0, 2], 6: [2, 4, 6]}),
    ],
)
def test_window_starts(spark, size, slide, want):
    df = spark.createDataFrame([(t,) for t in want], "ts long").select("ts", fn.window_starts(F.col("ts"), size, slide).alias("w"))
    assert {r["ts"]: r["w"] for r in df.collect()} == want


def test_window_sizes_are_positive(spark):
    for size, slide in ((0, 1), (1, 0), (-1, 1)):
        with pytest.raises(ValueError):
            fn.window_starts(F.lit(1), size, slide)


def test_window_label(spark):
    assert spark.range(1).select(fn.window_label(F.lit(3), F.lit(8)).alias("l")).first()["l"] == "[3, 8)"


def simulate(rows, size, slide):
    """Record at a time: (seq, key, ts, wm) -> Counter of (key, start, pane, n)."""
    clock, held, out = {}, {}, []
    for seq, key, ts, wm in rows:
        own = held.setdefault(key, {})
        start = ts // slide * slide
        while start > ts - size:
            if start >= 0 and ts >= 0:
                own[start] = own.get(start, 0) + 1
            start -= slide
        clock[key] = max(clock.get(key, wm), wm)
        for start in [s for s in own if s + size <= clock[key]]:
            out.append((key, start, seq, own.pop(start)))
    return sorted(out, key=str)


GOLDEN = [
    (1, "foo"), (1, "foo"), (2, "foo"), (8, "foo"), (5, "foo"), (5, "buz"), (5, "buz"), (7, "buz"), (6, "buz"), (10, "foo"), (10, "bar"), (10, "buz"),
    (2, "foo"), (13, "bar"), (15, "buz"), (3, "buz"), (31, "foo"), (31, "bar"), (30, "foo"), (20, "bar"), (100, "foo"), (100, "bar"), (100, "buz"),
]
GOLDEN_PANES = {
    "foo": [(0, 3), (2, 3), (0, 1), (4, 2), (6, 2), (8, 2), (10, 1), (26, 1), (28, 2), (30, 2)],
    "bar": [(6, 1), (8, 1), (10, 2), (12, 1), (28, 1), (30, 1), (16, 1), (18, 1), (20, 1)],
    "buz": [(2, 3), (4, 4), (6, 3), (8, 1), (10, 1), (12, 1), (14, 1), (0, 1), (2, 1)],
}


def timed(spark, rows, delay=5):
    df = spark.createDataFrame([(i, t, k) for i, (t, k) in enumerate(rows)], "seq long, ts long, value string")
    return op.watermark(op.assign_time(df, F.col("ts"), F.col("ts") - delay))


def test_golden_panes(spark, ranges):
    got = op.fire(timed(spark, GOLDEN), ("value",), 5, 2, n=F.count("*")).collect()
    assert len(got) == 28
    for key, want in GOLDEN_PANES.items():
        assert sorted((r["start"], r["n"]) for r in got if r["value"] == key) == sorted(want)


def test_windows_close_by_key(spark, ranges):
    a = op.fire(timed(spark, [(2, "buz"), (13, "bar"), (3, "buz"), (10, "buz")]), ("value",), 5, 2, n=F.count("*"))
    assert sorted((r["value"], r["start"], r["n"]) for r in a.collect()) == [("buz", 0, 2), ("buz", 2, 2)]
    b = op.fire(timed(spark, [(2, "buz"), (13, "bar"), (10, "buz"), (3, "buz")]), ("value",), 5, 2, n=F.count("*"))
    assert sorted((r["value"], r["start"], r["n"]) for r in b.collect()) == [("buz", 0, 1), ("buz", 0, 1), ("buz", 2, 1), ("buz", 2, 1)]


def test_tumbling_sum_with_late_rows(spark, ranges):
    rows = [(1, 1, 1), (1, 3, 2), (4, 0, 4), (5, 0, 5), (5, 0, 5), (6, 0, 6), (8, 0, 8), (9, 0, 9), (12, 12, 12), (1, 0, 12), (11, 0, 11)]
    df = spark.createDataFrame([(i + 1, *r) for i, r in enumerate(rows)], "seq long, ts long, wm long, value long")
    df = op.watermark(op.assign_time(df.withColumn("key", F.lit(0)), F.col("ts"), F.col("wm")))
    got = op.fire(df, ("key",), 3, 3, total=F.sum("value")).collect()
    assert sorted((r["pane"], r["total"]) for r in got) == [(2, 3), (9, 9), (9, 14), (9, 14), (10, 12), (11, 11)]


@pytest.mark.parametrize(("size", "slide", "seed"), [(5, 2, 0), (4, 4, 1), (3, 7, 2), (10, 1, 3)])
def test_panes_on_random_rows(spark, ranges, size, slide, seed):
    rng = random.Random(seed)
    rows = [(i, rng.choice(["a", "b", None]), max(-3, i // 2 + rng.randrange(-8, 4))) for i in range(80)]
    df = spark.createDataFrame(rows, "seq long, key string, ts long")
    df = op.watermark(op.assign_time(df, F.col("ts"), F.col("ts") - 2))
    clock, sim = -(10**9), []
    for i, k, ts in rows:
        clock = max(clock, ts - 2)
        sim.append((i, k, ts, clock))
    got = op.fire(df, ("key",), size, slide, n=F.count("*")).collect()
    assert sorted(((r["key"], r["start"], r["pane"], r["n"]) for r in got), key=str) == simulate(sim, size, slide)


def test_early_results(spark, ranges):
    got = op.fire_each(timed(spark, GOLDEN), ("value",), 5, 2, n=("count", F.lit(1))).where("value = 'foo' and start = 0").orderBy("seq").collect()
    assert [(r["seq"], r["pane"], r["n"]) for r in got] == [(0, 9, 1), (1, 9, 2), (2, 9, 3), (12, 12, 1)]


def test_windows_need_timestamps(spark):
    df = spark.createDataFrame([(0, "a", None, 3)], "seq long, key string, _ts long, _wm long")
    with pytest.raises(PySparkException):
        op.fire(df, ("key",), 5, 5, n=F.count("*")).collect()
    assert op.fire(df.limit(0), ("key",), 5, 5, n=F.count("*")).count() == 0


def test_time_conversion(spark):
    df = spark.createDataFrame([(1_700_000_000_123_456_789,), (-1,), (0,)], "n long")
    got = df.select("n", fn.nanos_of_timestamp(fn.timestamp_of_nanos(F.col("n"))).alias("b")).collect()
    assert {r["n"]: r["b"] for r in got} == {1_700_000_000_123_456_789: 1_700_000_000_123_456_000, -1: -1000, 0: 0}


# Sources


def numbers(instance: int, instances: int):
    yield from ((i, i * i) for i in range(instance, 10, instances))


def test_generator_source(spark):
    spark.dataSource.register(sources.GeneratorSource)
    df = spark.read.format("generator").option("spec", "tests.test_streams:numbers").option("parallelism", 3).load()
    assert sorted((r["seq"], r["value"]) for r in df.collect()) == [(i, i * i) for i in range(10)]
    assert df.rdd.getNumPartitions() == 3


def test_words_and_copies(spark):
    vocabulary = sources.vocabulary()
    assert len(set(vocabulary)) == 128 and 5.5 < sum(map(len, vocabulary)) / 128 < 7
    df = sources.words(spark, 5000)
    assert df.count() == 5000 and df.select("value").distinct().count() == 128
    assert sources.replicated(stream(spark, [1, 2], "int"), 3).count() == 6


def test_opaque_functions_and_other_assigners(spark):
    def upper(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("seq"), pc.utf8_upper(b.column("value"))], ["seq", "value"])

    got = op.apply_function(stream(spark, WORDS), upper, "seq long, value string")
    assert sinks.log(got, "string") == [w.upper() for w in WORDS]
    day = op.windows_of(stream(spark, [5], "long"), 10, 10, "value", starts=F.array(F.lit(0), F.lit(-5)).cast("array<long>"))
    assert sorted((r["start"], r["stop"]) for r in day.collect()) == [(-5, 5), (0, 10)]


# Sinks


def test_sinks(spark, tmp_path):
    df = stream(spark, [3, 1, 2], "int")
    assert sinks.log(df, "int") == [3, 1, 2]
    with pytest.raises(TypeError):
        sinks.log(df, "string")
    sinks.discard(df)
    sinks.each_partition(df, lambda rows: list(rows))
    df.write.parquet(str(tmp_path / "in"))
    source = sources.file_stream(spark, str(tmp_path / "in"), "seq long, value int")
    sinks.stream_log(source, "logged").awaitTermination(120)
    assert sorted(r["value"] for r in spark.table("logged").collect()) == [1, 2, 3]
    seen = []
    sinks.stream_batches(source, lambda d, i: seen.extend(r["value"] for r in d.collect()), str(tmp_path / "cp")).awaitTermination(120)
    assert sorted(seen) == [1, 2, 3]


def test_even_cuts_cover_all_positions(spark):
    cuts = ordered.EvenCuts(10, 4)
    rows = spark.createDataFrame([(i,) for i in [None, -3, *range(10), 12]], "seq long").select("seq", cuts.place(F.col("seq")).alias("r")).collect()
    assert [r["r"] for r in rows] == [0, 0, 0, 0, 0, 1, 1, 2, 2, 2, 3, 3, 3]
    assert ordered.ranges_of(spark) == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_own_assigner_fires(spark):
    rows = [(i, "k", t, t) for i, t in enumerate([3, 4, 9, 14, 30])]
    timed = op.assign_time(spark.createDataFrame(rows, "seq long, key string, ts long, wm long"), F.col("ts"), F.col("wm"))
    starts = F.array(F.col("_ts") - F.pmod(F.col("_ts") - 2, F.lit(5)))
    got = op.fire(op.watermark(timed), ("key",), 5, 5, starts=starts, n=F.count("*")).collect()
    assert sorted((r["start"], r["pane"], r["n"]) for r in got) == [(2, 2, 2), (7, 3, 1), (12, 4, 1)]


def test_salted_fold_parts_repeated_rows(spark):
    same = spark.createDataFrame([("k", 1)] * 400, "key string, v int").repartition(4)
    out = keyed.salted_fold(same, ("key",), 8, {"n": F.count("*")}, {"n": F.sum("n")})
    assert [(r["key"], r["n"]) for r in out.collect()] == [("k", 400)]


def test_set_operations(spark):
    a, b = (spark.createDataFrame([(x,) for x in v], "v int") for v in ([1, 1, 2, None], [1, None, 3]))
    assert {r["v"] for r in op.merge_intersect(a, b).collect()} == {1, None}
    assert [r["v"] for r in op.merge_except(a, b).collect()] == [2]
