"""Topologies and graph operators."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from strandflow import operators as op
from strandflow.plans import Topology, TopologyError, graph
from strandflow.queries import EDGES
from strandflow.sources import elements


def same(d):
    return d


def build(spark):
    flow = Topology()
    nodes = {i: flow.source(f"n{i}", elements(spark, [i])) if i in (0, 6) else flow.node(f"n{i}", same) for i in range(8)}
    for _, a, b in EDGES:
        flow.connect(nodes[a], nodes[b])
    return flow, nodes


def test_listing_roots_and_layers(spark):
    flow, _ = build(spark)
    assert str(flow).splitlines() == [f"n{a} -> n{b}" for a, b in [(0, 1), (1, 2), (1, 3), (2, 4), (3, 4), (4, 5), (6, 7)]]
    assert flow.roots() == ["n0", "n6"]
    assert flow.layers() == [["n0", "n6"], ["n1", "n7"], ["n2", "n3"], ["n4"], ["n5"]]
    assert flow.successors("n1") == ["n2", "n3"]


def test_diamond_delivers_once_a_path_edge(spark):
    flow, _ = build(spark)
    got = flow.run("n4").collect()
    assert sorted((r["value"], r["_source"]) for r in got) == [(0, 0), (0, 1)]


def test_paths_of_different_length_deliver_once(spark):
    flow = Topology()
    a, b, c = flow.source("a", elements(spark, [1])), flow.node("b", same), flow.node("c", same)
    flow.connect(flow.connect(a, b), c)
    flow.connect(a, c)
    d = flow.node("d", lambda x: x.drop("_source"))
    flow.connect(c, d)
    assert flow.run("d").count() == 2


def test_double_edge(spark):
    flow = Topology()
    a, b = flow.source("a", elements(spark, [5])), flow.node("b", same)
    flow.connect(a, b)
    flow.connect(a, b)
    assert sorted(r["_source"] for r in flow.run("b").collect()) == [0, 1]


def test_refusals(spark):
    flow, nodes = build(spark)
    for a, b in ((5, 1), (2, 2)):
        with pytest.raises(TopologyError, match="cycle"):
            flow.connect(nodes[a], nodes[b])
    with pytest.raises(TopologyError, match="source"):
        flow.connect(nodes[5], nodes[6])
    with pytest.raises(TopologyError, match="already"):
        flow.node("n1", same)
    keyed = flow.node("keyed", same)
    flow.connect(nodes[5], keyed, key=F.col("value") % 2)
    with pytest.raises(TopologyError, match="different keys"):
        flow.connect(nodes[7], keyed, key=F.col("value") % 3)
    with pytest.raises(TopologyError, match="not a node"):
        flow.connect(Topology().node("x", same), keyed)
    flow.node("lonely", same)
    with pytest.raises(TopologyError, match="no input"):
        flow.build()


def test_keyed_node_with_parallelism(spark):
    flow = Topology()
    words = flow.source("words", elements(spark, ["a", "b", "a"], "string"))
    counts = flow.node("counts", lambda d: op.running_fold(d, {"n": ("count", F.lit(1))}, ("key",)), parallelism=4)
    flow.connect(words, counts, key=F.col("value"))
    assert sorted((r["value"], r["n"]) for r in flow.run("counts").collect()) == [("a", 1), ("a", 2), ("b", 1)]


def test_edge_lists(spark):
    edges = spark.createDataFrame(EDGES, "pos int, src int, dst int")
    assert sorted(r["node"] for r in graph.roots(edges).collect()) == [0, 6]
    assert sorted(r["dst"] for r in graph.adjacents(edges, F.lit(1)).collect()) == [2, 3]
    assert [r["edge"] for r in graph.sorted_edges(edges).orderBy("place").collect()] == [f"{a} -> {b}" for _, a, b in EDGES]
    assert {r["node"]: r["depth"] for r in graph.layers(edges).collect()} == {0: 0, 6: 0, 1: 1, 7: 1, 2: 2, 3: 2, 4: 3, 5: 4}
    loop = spark.createDataFrame([(0, 9, 1), (1, 1, 2), (2, 2, 1)], "pos int, src int, dst int")
    with pytest.raises(ValueError):
        graph.layers(loop)
    apart = spark.createDataFrame([(0, 9, 1), (1, 5, 6), (2, 6, 5)], "pos int, src int, dst int")
    with pytest.raises(ValueError):
        graph.layers(apart)


def test_layers_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i, i + 1) for i in range(70)], "pos int, src int, dst int").coalesce(1)
    assert {r["node"]: r["depth"] for r in graph.layers(edges).collect()} == {i: i for i in range(71)}


def test_rows_without_a_key_are_dealt_in_turn(spark):
    flow = Topology()
    numbers = flow.source("numbers", elements(spark, range(10)))
    counts = flow.node("counts", lambda d: op.running_fold(d, {"n": ("count", F.lit(1))}, ("key",)), parallelism=3)
    flow.connect(numbers, counts)
    assert sorted((r["seq"], r["key"], r["n"]) for r in flow.run("counts").collect()) == [(i, i % 3, i // 3 + 1) for i in range(10)]
