"""Registered queries of the stream engine, each with the SQL that says the same.

All read whole tables. Arrival order of ``events`` is ``event_id``; where a query
needs late data, arrival is deranged by a fixed rule (see ``ARRIVAL``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandflow import functions as fn
from strandflow import operators as op
from strandflow import sinks
from strandflow.operators.keyed import ordered_list
from strandflow.plans import Topology, graph
from strandflow.sources import ElementsBuilder, elements, events, replicated, table, vocabulary, words

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Hours of the windows over events: size, slide, delay, in seconds.
SIZE, SLIDE, DELAY = 6 * 3600, 4 * 3600, 3600
#: Arrival order with late rows: the key jumps by up to 97 places.
ARRIVAL = "event_id + (event_id * 7919) % 97"
EVENTS = "(select *, event_id as seq, cast(floor(epoch(ts)) as bigint) as sec from events)"
EDGES = [(0, 0, 1), (1, 1, 2), (2, 1, 3), (3, 2, 4), (4, 3, 4), (5, 4, 5), (6, 6, 7)]
EDGES_SQL = "(values " + ", ".join(map(str, EDGES)) + ") e(pos, src, dst)"


def query(sql: str):
    def register(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return register


# Sources and sinks


@query(f"select event_id, sec, user_id, event_type, value, props from {EVENTS}")
def scan_events(spark, sf):
    return events(spark, sf).select("event_id", "sec", "user_id", "event_type", "value", "props")


@query("select * from (values (0::bigint, 3::bigint), (1::bigint, 1::bigint), (2::bigint, 4::bigint), (3::bigint, 1::bigint)) e(seq, value)")
def source_elements(spark, sf):
    return elements(spark, [3, 1, 4, 1])


@query("select r_regionkey, r_name, cast(c as int) as _copy from region, range(3) t(c)")
def source_replicated(spark, sf):
    return replicated(table(spark, sf, "region"), 3).select("r_regionkey", "r_name", "_copy")


@query("select cast(v * 2 as bigint) as value from range(1, 6) t(v)")
def naive_map_double(spark, sf):
    stream = ElementsBuilder().add(1, 2, 3).add(4, 5).stream(spark)
    return op.flat_map(stream, F.array(F.col("value") * 2))


#: Words of the reference benchmark: 10 MiB of them from a vocabulary of 128.
WORDS = 1_703_000
DRAWN = f"(select id as seq, (id % 2147483648) * 2654435761 % 4294967296 as x from range({WORDS}) t(id))"
DRAWN = f"(select seq, cast(floor((x // 65536 + x % 65536 * 65536) * 40503 % 4294967296 / 4096) as bigint) % 128 as i from {DRAWN})"
GENERATED = f"(select cast(seq as bigint) as seq, ([{', '.join(repr(w) for w in vocabulary())}])[i + 1] as value from {DRAWN})"


@query(f"select seq, value from {GENERATED}")
def generated_words(spark, sf):
    return words(spark, WORDS)


@query(f"select seq, value || ': ' || count(*) over (partition by value order by seq rows unbounded preceding) as value from {GENERATED}")
def bench_wordcount(spark, sf):
    counted = op.running_fold(words(spark, WORDS), {"n": ("count", F.lit(1))}, ("value",), cuts=op.even_cuts(spark, WORDS))
    return counted.select("seq", F.concat_ws(": ", "value", "n").alias("value"))


@query("""
with w as (select doc_id, unnest(string_split(text, ' ')) as word, generate_subscripts(string_split(text, ' '), 1) as i from documents)
select word, doc_id * 1000000 + i as seq, cast(count(*) over (partition by word order by doc_id, i rows unbounded preceding) as bigint) as n from w""")
def wordcount_running(spark, sf):
    counted = op.running_parts(table(spark, sf, "documents"), "text", "doc_id", names=("i", "word", "n"))
    return counted.select("word", (F.col("doc_id") * 1000000 + F.col("i") + 1).alias("seq"), "n")


@query("select cast(r_regionkey as bigint) as seq, r_name as value from region")
def sink_log(spark, sf):
    """What the log took, in order; it refuses a stream of another type."""
    names = table(spark, sf, "region").select(F.col("r_regionkey").cast("long").alias("seq"), F.col("r_name").alias("value"))
    taken = sinks.log(names, "string")
    try:
        sinks.log(names, "bigint")
    except TypeError:
        return elements(spark, taken, "string")
    raise AssertionError("the log took strings for numbers")


# Projection, filter, generator


@query("select p_partkey, upper(p_name) as value from part")
def map_upper(spark, sf):
    return op.map_values(table(spark, sf, "part"), p_partkey=F.col("p_partkey"), value=F.upper("p_name"))


@query("select doc_id, cast(strlen(text) as bigint) as value from documents")
def map_length(spark, sf):
    return op.map_values(table(spark, sf, "documents"), doc_id=F.col("doc_id"), value=fn.byte_length(F.col("text")).cast("long"))


@query("select l_orderkey, l_linenumber, cast(l_linenumber * k as bigint) as value from lineitem, range(1, 5) t(k)")
def flat_map_multiples(spark, sf):
    values = F.transform(F.sequence(F.lit(1), F.lit(4)), lambda k: (F.col("l_linenumber") * k).cast("long"))
    return op.flat_map(table(spark, sf, "lineitem"), values, keep=("l_orderkey", "l_linenumber"))


@query("select event_id, value from events where value > 50 and event_type <> 'view'")
def filter_threshold(spark, sf):
    return op.pass_through(op.keep(table(spark, sf, "events"), (F.col("value") > 50) & (F.col("event_type") != "view"))).select("event_id", "value")


@query("select event_id, event_type, sec from " + EVENTS)
def struct_field_access(spark, sf):
    boxed = events(spark, sf).select("event_id", F.struct(F.col("sec").alias("ts"), F.col("event_type").alias("value")).alias("record"))
    return boxed.select("event_id", F.col("record.value").alias("event_type"), F.col("record.ts").alias("sec"))


# Keys and partitions


@query("select event_type as key, cast(count(*) as bigint) as n, cast(min(event_id) as bigint) as first_seq, cast(max(event_id) as bigint) as last_seq from events group by 1")
def key_by_string(spark, sf):
    keyed = op.key_by(events(spark, sf), F.col("event_type"))
    return op.final_fold(keyed, ("key",), n=F.count("*"), first_seq=F.min("seq"), last_seq=F.max("seq"))


@query("""
with k(event_type, key) as (values ('click', 10118785259804131855::decimal(20,0)), ('purchase', 840177994891325634::decimal(20,0)), ('error', 11489899660447141169::decimal(20,0)), ('signup', 5803927774592936137::decimal(20,0)), ('view', 18322600418174592600::decimal(20,0)))
select event_type, cast(key as varchar) as key, cast(key % 4 as int) as partition, cast(count(*) as bigint) as n from events join k using (event_type) group by all""")
def fnv_partition(spark, sf):
    types = op.final_fold(events(spark, sf), ("event_type",), n=F.count("*"))  # the hash runs once a key
    keyed = types.withColumn("key", fn.fnv1a64(F.col("event_type")))
    return keyed.select("event_type", F.col("key").cast("string").alias("key"), (F.col("key") % 4).cast("int").alias("partition"), "n")


@query("select cast(user_id % 7 as bigint) as key, cast(count(*) as bigint) as n from events group by 1")
def key_by_modulo(spark, sf):
    return op.final_fold(op.key_by(events(spark, sf), F.col("user_id") % 7), ("key",), n=F.count("*"))


@query("select cast(0 as int) as key, cast(count(*) as bigint) as n, cast(max(event_id) as bigint) as last_seq from events")
def key_fixed_global(spark, sf):
    return op.final_fold(op.key_by(events(spark, sf), F.lit(0)), ("key",), n=F.count("*"), last_seq=F.max("seq"))


@query("""
with p as (select seq, cast((row_number() over (order by seq) - 1) % 4 as int) as partition from (select event_id as seq from events))
select seq, partition, cast(count(*) over (partition by partition order by seq rows unbounded preceding) as bigint) as n from p""")
def round_robin_count(spark, sf):
    dealt = op.round_robin(events(spark, sf).select("seq"), 4)
    return op.running_fold(dealt, {"n": ("count", F.lit(1))}, ("_partition",)).select("seq", F.col("_partition").alias("partition"), "n")


@query("select event_id as seq, cast(user_id % 4 as int) as partition from events")
def partition_modulo(spark, sf):
    return op.with_partition(events(spark, sf), F.col("user_id"), 4).select("seq", F.col("_partition").alias("partition"))


@query("select p_partkey, upper(p_name) as value, 0 as branch from part union all select p_partkey, cast(strlen(p_name) as varchar), 1 from part")
def fan_out_union(spark, sf):
    part = table(spark, sf, "part")
    upper, size = op.fan_out(
        part,
        lambda d: d.select("p_partkey", F.upper("p_name").alias("value")),
        lambda d: d.select("p_partkey", fn.byte_length(F.col("p_name")).cast("string").alias("value")),
    )
    return op.merge(upper, size).withColumnRenamed("_source", "branch")


# Several inputs


@query("select c_custkey as id, 0 as source from customer union all select s_suppkey, 1 from supplier union all select p_partkey, 2 from part")
def merge_tagged(spark, sf):
    inputs = [table(spark, sf, t).select(F.col(c).alias("id")) for t, c in (("customer", "c_custkey"), ("supplier", "s_suppkey"), ("part", "p_partkey"))]
    return op.merge(*inputs).withColumnRenamed("_source", "source")


@query("select c_custkey as id, upper(c_name) as value from customer union all select s_suppkey, cast(strlen(s_name) as varchar) from supplier")
def merge_dispatch(spark, sf):
    inputs = [table(spark, sf, t).select(F.col(c).alias("id"), F.col(n).alias("name")) for t, c, n in (("customer", "c_custkey", "c_name"), ("supplier", "s_suppkey", "s_name"))]
    return op.merge(*inputs).select("id", op.dispatch(F.upper("name"), fn.byte_length(F.col("name")).cast("string")).alias("value"))


@query("select n_nationkey, 0 as source from nation union all select n_nationkey, 1 from nation")
def merge_self(spark, sf):
    nation = table(spark, sf, "nation").select("n_nationkey")
    return op.merge(nation, nation).withColumnRenamed("_source", "source")


@query("""
with a as (select event_id, row_number() over (order by event_id) as p from events),
b as (select o_orderkey, row_number() over (order by o_orderkey) as p from orders)
select cast(p - 1 as bigint) as pos, event_id, o_orderkey from a join b using (p)""")
def align_zip(spark, sf):
    left = events(spark, sf).select("seq", "event_id")
    right = table(spark, sf, "orders").select(F.col("o_orderkey").alias("seq"), "o_orderkey")
    pairs = op.align(left, right)
    return pairs.select(F.col("_pos").alias("pos"), F.col("left.event_id").alias("event_id"), F.col("right.o_orderkey").alias("o_orderkey"))


@query("select o_orderkey, l_linenumber, o_custkey, l_quantity from orders join lineitem on o_orderkey = l_orderkey")
def keyed_join(spark, sf):
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_quantity")
    return op.keyed_join(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), lines, ["o_orderkey"]).select("o_orderkey", "l_linenumber", "o_custkey", "l_quantity")


@query("select c_nationkey as nation from customer union select s_nationkey from supplier")
def merge_distinct(spark, sf):
    return op.merge_distinct(table(spark, sf, "customer").select(F.col("c_nationkey").alias("nation")), table(spark, sf, "supplier").select(F.col("s_nationkey").alias("nation")))


@query("select c_nationkey as nation from customer intersect select s_nationkey from supplier")
def merge_intersect(spark, sf):
    return op.merge_intersect(table(spark, sf, "customer").select(F.col("c_nationkey").alias("nation")), table(spark, sf, "supplier").select(F.col("s_nationkey").alias("nation")))


@query("select n_nationkey as nation from nation except select s_nationkey from supplier")
def merge_except(spark, sf):
    return op.merge_except(table(spark, sf, "nation").select(F.col("n_nationkey").alias("nation")), table(spark, sf, "supplier").select(F.col("s_nationkey").alias("nation")))


# State


@query("select event_type, event_id as seq, cast(count(*) over (partition by event_type order by event_id rows unbounded preceding) as bigint) as n from events")
def keyed_running_count(spark, sf):
    return op.running_fold(events(spark, sf), {"n": ("count", F.lit(1))}, ("event_type",)).select("event_type", "seq", "n")


@query("select event_id as seq, cast(sum(cast(round(value * 100) as bigint)) over (order by event_id rows unbounded preceding) as bigint) as total from events")
def running_sum(spark, sf):
    cents = F.round(F.col("value") * 100).cast("long")
    return op.running_fold(events(spark, sf), {"total": ("sum", cents)}).select("seq", "total")


@query("select user_id, cast(count(*) as bigint) as n, cast(max(event_id) as bigint) as last_seq, arg_max(event_type, event_id) as last_type from events group by user_id")
def keyed_final_count(spark, sf):
    return op.final_fold(events(spark, sf), ("user_id",), n=F.count("*"), last_seq=F.max("seq"), last_type=F.max_by("event_type", "seq"))


@query("select user_id, string_agg(event_type, ',' order by event_id) as types from events group by user_id")
def collect_list_by_key(spark, sf):
    return events(spark, sf).groupBy("user_id").agg(F.concat_ws(",", ordered_list(F.col("event_type"), F.col("seq"))).alias("types"))


@query("select user_id, min(event_id) as seq, arg_min(event_type, event_id) as event_type from events group by user_id")
def dedupe_first(spark, sf):
    return op.dedupe_first(events(spark, sf).select("user_id", "seq", "event_type"), ("user_id",))


@query("""
select user_id, event_id as seq, cast(count(*) filter (event_type = 'purchase') over (partition by user_id order by event_id rows unbounded preceding) as bigint) as purchases from events""")
def stateful_fold(spark, sf):
    def step(n: int, row: dict) -> tuple[int, list[tuple]]:
        n += row["event_type"] == "purchase"
        return n, [(row["user_id"], row["seq"], n)]

    return op.fold_opaque(events(spark, sf).select("user_id", "seq", "event_type"), ("user_id",), 0, step, "user_id long, seq long, purchases long")


# Event time


@query(f"select event_id as seq, sec as ts, sec - {DELAY} as wm from {EVENTS}")
def assign_timestamp(spark, sf):
    return op.assign_time(events(spark, sf), F.col("sec"), F.col("sec") - DELAY).select("seq", F.col("_ts").alias("ts"), F.col("_wm").alias("wm"))


@query("select event_id as seq, cast(epoch_us(ts) * 1000 as bigint) as nanos, cast(epoch_us(ts) as bigint) as micros from events")
def time_roundtrip(spark, sf):
    nanos = events(spark, sf).select("seq", fn.nanos_of_timestamp(F.col("ts").cast("timestamp")).alias("nanos"))
    return nanos.withColumn("micros", F.unix_micros(fn.timestamp_of_nanos(F.col("nanos"))))


def _cuts(base: DataFrame) -> dict:
    """Cuts of arrival order and of time, from the table itself."""
    return {"cuts": op.even_cuts(base.sparkSession, base.count()), "time_cuts": op.quantile_cuts(base, "sec")}


def timed_events(spark: SparkSession, sf: str) -> tuple[DataFrame, dict]:
    """Events in order with timestamps and operator-wide watermarks, and where to cut them."""
    base = events(spark, sf)
    cuts = _cuts(base)
    return op.watermark(op.assign_time(base, F.col("sec"), F.col("sec") - DELAY), cuts=cuts["cuts"]), cuts


def late_events(spark: SparkSession, sf: str) -> tuple[DataFrame, dict]:
    """The same with deranged arrival and each row's own watermark."""
    base = events(spark, sf)
    cuts = _cuts(base)
    arrived = op.number(base.drop("seq").withColumn("_a", F.expr(ARRIVAL)), "_a", "seq", ties=("event_id",), cuts=cuts["cuts"]).drop("_a")
    return op.assign_time(arrived, F.col("sec"), F.col("sec") - DELAY), cuts


LATE = f"(select *, row_number() over (order by {ARRIVAL}, event_id) - 1 as seq, cast(floor(epoch(ts)) as bigint) as sec from events)"


@query(f"select seq, sec as ts, max(sec - {DELAY}) over (order by seq rows unbounded preceding) as wm from {LATE}")
def watermark_running(spark, sf):
    late, cuts = late_events(spark, sf)
    return op.watermark(late, cuts=cuts["cuts"]).select("seq", F.col("_ts").alias("ts"), F.col("_wm").alias("wm"))


_BY_SOURCE = ", ".join(f"max(case when user_id % 3 = {i} then sec - {DELAY} end) over (order by seq rows unbounded preceding)" for i in range(3))


@query(f"select seq, least({_BY_SOURCE}) as wm from {LATE}")
def watermark_multi_source(spark, sf):
    late, cuts = late_events(spark, sf)
    tagged = late.withColumn("_source", F.col("user_id") % 3)
    return op.merged_watermark(tagged, "_source", [0, 1, 2], cuts=cuts["cuts"]).select("seq", F.col("_wm").alias("wm"))


# Windows


def _assigned(size: int, slide: int) -> str:
    steps = -(-size // slide)
    return f"(select e.*, (sec // {slide} - i) * {slide} as start from {EVENTS} e, range({steps}) t(i) where (sec // {slide} - i) * {slide} >= 0 and sec < (sec // {slide} - i) * {slide} + {size})"


@query(f"select seq, start, start + {SIZE} as stop from {_assigned(SIZE, SLIDE)}")
def window_assign(spark, sf):
    return op.windows_of(events(spark, sf), SIZE, SLIDE, "sec").select("seq", "start", "stop")


@query(f"select start, '[' || start || ', ' || (start + {SIZE}) || ')' as label, cast(count(*) as bigint) as n from {_assigned(SIZE, SLIDE)} group by 1, 2")
def window_label(spark, sf):
    found = op.windows_of(events(spark, sf), SIZE, SLIDE, "sec").groupBy("start", "stop").agg(F.count("*").alias("n"))
    return found.select("start", fn.window_label(F.col("start"), F.col("stop")).alias("label"), "n")


def _fired(size: int, slide: int, order: str = EVENTS, shift: int = 0) -> str:
    """Panes by rows: closing rows are found by an inequality join. ``shift`` moves the starts."""
    steps = -(-size // slide)
    start = f"((sec - {shift}) // {slide} - i) * {slide} + {shift}"
    return f"""
e as materialized (select event_type, user_id, event_id, value, seq, sec from {order}),
g as (select *, max(sec - {DELAY}) over (order by seq rows unbounded preceding) as wm from e),
k as materialized (select *, max(wm) over (partition by event_type order by seq rows unbounded preceding) as eff from g),
w as materialized (select k.*, {start} as start from k, range({steps}) t(i) where {start} >= 0 and sec < {start} + {size}),
s as (select distinct event_type, start from w),
d as (select event_type, eff, min(seq) as seq from k group by 1, 2),
c as (select s.event_type, s.start, min(d.seq) as closed from s join d on d.event_type = s.event_type and d.eff >= s.start + {size} group by 1, 2),
p as (select w.*, greatest(w.seq, c.closed) as pane from w join c on w.event_type = c.event_type and w.start = c.start)"""


@query(f"with {_fired(SIZE, SIZE)} select event_type, start, pane, cast(sum(cast(round(value * 100) as bigint)) as bigint) as total from p group by 1, 2, 3")
def window_tumbling_sum(spark, sf):
    timed, cuts = timed_events(spark, sf)
    return op.fire(timed, ("event_type",), SIZE, SIZE, **cuts, total=F.sum(F.round(F.col("value") * 100).cast("long"))).select("event_type", "start", "pane", "total")


@query(f"with {_fired(SIZE, SLIDE)} select event_type, start, pane, cast(count(*) as bigint) as n from p group by 1, 2, 3")
def window_sliding_count(spark, sf):
    timed, cuts = timed_events(spark, sf)
    return op.fire(timed, ("event_type",), SIZE, SLIDE, **cuts, n=F.count("*")).select("event_type", "start", "pane", "n")


@query(f"with {_fired(SLIDE, SIZE)} select event_type, start, pane, cast(count(*) as bigint) as n from p group by 1, 2, 3")
def window_gapped_count(spark, sf):
    timed, cuts = timed_events(spark, sf)
    return op.fire(timed, ("event_type",), SLIDE, SIZE, **cuts, n=F.count("*")).select("event_type", "start", "pane", "n")


@query(f"with {_fired(SIZE, SLIDE, LATE)} select event_type, start, pane, cast(count(*) as bigint) as n from p group by 1, 2, 3")
def window_panes_late(spark, sf):
    late, cuts = late_events(spark, sf)
    return op.fire(op.watermark(late, cuts=cuts["cuts"]), ("event_type",), SIZE, SLIDE, **cuts, n=F.count("*")).select("event_type", "start", "pane", "n")


@query(f"with {_fired(SIZE, SIZE, LATE)} select event_type, start, pane, string_agg(event_id, ',' order by seq) as ids from p group by 1, 2, 3")
def window_collect(spark, sf):
    late, cuts = late_events(spark, sf)
    fired = op.fire(op.watermark(late, cuts=cuts["cuts"]), ("event_type",), SIZE, SIZE, **cuts, ids=F.concat_ws(",", ordered_list(F.col("event_id").cast("string"), F.col("seq"))))
    return fired.select("event_type", "start", "pane", "ids")


@query(f"with {_fired(SIZE, SLIDE, LATE)} select event_type, start, pane, seq, cast(count(*) over (partition by event_type, start, pane order by seq rows unbounded preceding) as bigint) as n from p")
def window_running_count(spark, sf):
    late, cuts = late_events(spark, sf)
    each = op.fire_each(op.watermark(late, cuts=cuts["cuts"]), ("event_type",), SIZE, SLIDE, **cuts, n=("count", F.lit(1)))
    return each.select("event_type", "start", "pane", "seq", "n")


#: Another assigner: tumbling windows that begin half an hour late.
SHIFT = 1800


@query(f"with {_fired(SIZE, SIZE, LATE, SHIFT)} select event_type, start, pane, cast(count(*) as bigint) as n from p group by 1, 2, 3")
def window_own_assigner(spark, sf):
    late, cuts = late_events(spark, sf)
    start = F.col("_ts") - F.pmod(F.col("_ts") - SHIFT, F.lit(SIZE))
    starts = F.filter(F.array(start), lambda s: s >= 0)
    return op.fire(op.watermark(late, cuts=cuts["cuts"]), ("event_type",), SIZE, SIZE, **cuts, starts=starts, n=F.count("*")).select("event_type", "start", "pane", "n")


# JSON and nulls


@query("select event_id, json_extract_string(props, '$.k') as k, json_extract_string(props, '$.absent') as absent from events")
def json_fields(spark, sf):
    return table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), F.get_json_object("props", "$.absent").alias("absent"))


NULLED = "(select event_id as seq, case when user_id % 5 <> 0 then user_id % 5 end as key, case when event_id % 3 <> 0 then cast(round(value * 100) as bigint) end as cents from events)"


@query(f"select seq, coalesce(key, -1) as key, cast(count(cents) over w as bigint) as n, cast(coalesce(sum(cents) over w, 0) as bigint) as total from {NULLED} window w as (partition by key order by seq rows unbounded preceding)")
def null_keys_and_values(spark, sf):
    """A null key is a key of its own; null values change no fold."""
    base = events(spark, sf)
    rows = base.select("seq", F.when(F.col("user_id") % 5 != 0, F.col("user_id") % 5).alias("key"), F.when(F.col("event_id") % 3 != 0, F.round(F.col("value") * 100).cast("long")).alias("cents"))
    cents = F.col("cents")
    folded = op.running_fold(rows, {"n": ("count", cents), "total": ("sum", cents)}, ("key",), cuts=op.even_cuts(spark, base.count()))
    return folded.select("seq", F.coalesce("key", F.lit(-1)).alias("key"), "n", F.coalesce("total", F.lit(0)).cast("long").alias("total"))


# Topologies


def _edges(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(EDGES, "pos int, src int, dst int")


@query(f"select distinct src as node from {EDGES_SQL} where src not in (select dst from {EDGES_SQL})")
def graph_roots(spark, sf):
    return graph.roots(_edges(spark))


@query(f"select pos, dst from {EDGES_SQL} where src = 1")
def graph_adjacents(spark, sf):
    return graph.adjacents(_edges(spark), F.lit(1))


@query(f"select cast(row_number() over (order by src, pos) - 1 as int) as place, src || ' -> ' || dst as edge from {EDGES_SQL}")
def graph_edges_sorted(spark, sf):
    return graph.sorted_edges(_edges(spark))


@query(f"""
with recursive e as (select * from {EDGES_SQL}), l(node, depth) as (
select distinct src, 0 from e where src not in (select dst from e) union all select e.dst, l.depth + 1 from l join e on l.node = e.src where l.depth < (select count(*) from e))
select node, max(depth) as depth from l group by node""")
def graph_layers(spark, sf):
    return graph.layers(_edges(spark))


@query("""
with u as (select p_partkey as seq, upper(p_name) as name, strlen(p_name) as size, p_size % 5 as key from part)
select seq, name || ': ' || size as value, cast(sum(size) over (partition by key order by seq rows unbounded preceding) as bigint) as total from u""")
def topology_pipeline(spark, sf):
    flow = Topology()
    parts = flow.source("parts", table(spark, sf, "part").select(F.col("p_partkey").alias("seq"), "p_name", "p_size"))
    upper = flow.node("upper", lambda d: d.select("seq", "p_size", F.upper("p_name").alias("name")))
    sized = flow.node("sized", lambda d: d.withColumn("size", fn.byte_length(F.col("name")).cast("long")))
    total = flow.node("total", lambda d: op.running_fold(d, {"total": ("sum", F.col("size"))}, ("key",)))
    flow.connect(parts, upper)
    flow.connect(upper, sized)
    flow.connect(sized, total, key=F.col("p_size") % 5)
    return flow.run("total").select("seq", F.concat_ws(": ", "name", "size").alias("value"), "total")
