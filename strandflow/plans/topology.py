"""Named pipelines: a directed acyclic graph of nodes that compiles to DataFrames.

>>> flow = Topology()
>>> words = flow.source("words", df)
>>> counts = flow.node("counts", lambda df: running_fold(df, {"n": ("count", F.lit(1))}, ("value",)))
>>> flow.connect(words, counts, key=F.col("value"))
>>> flow.run("counts")

A node with several in-edges gets their tagged merge. All in-edges of a node
must agree on its key; cycles are rejected when they are closed; each edge
delivers once, however many paths lead to it, and connecting a pair twice
delivers twice.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame

from strandflow.operators.combine import merge
from strandflow.operators.keyed import round_robin

KEY = "key"


class TopologyError(ValueError):
    """A pipeline that can't be built."""


@dataclass
class Node:
    name: str
    apply: Callable[[DataFrame], DataFrame] | None = None
    data: DataFrame | None = None
    parallelism: int | None = None


@dataclass
class Edge:
    source: str
    target: str
    key: Column | None = None


@dataclass
class Topology:
    nodes: dict[str, Node] = field(default_factory=dict)
    edges: list[Edge] = field(default_factory=list)

    def _add(self, node: Node) -> Node:
        if node.name in self.nodes:
            raise TopologyError(f"there is a node {node.name} already")
        self.nodes[node.name] = node
        return node

    def source(self, name: str, data: DataFrame) -> Node:
        return self._add(Node(name, data=data))

    def node(self, name: str, apply: Callable[[DataFrame], DataFrame], parallelism: int | None = None) -> Node:
        """``parallelism``: partitions that the node's input is dealt into, by its key if it has one."""
        return self._add(Node(name, apply, parallelism=parallelism))

    def connect(self, source: Node, target: Node, key: Column | None = None) -> Node:
        """Adds an edge and returns its target, so that calls chain."""
        for n in (source, target):
            if self.nodes.get(n.name) is not n:
                raise TopologyError(f"{n.name} is not a node of this topology")
        if target.data is not None:
            raise TopologyError(f"{target.name} is a source")
        others = [e.key for e in self.edges if e.target == target.name]
        if others and str(others[0]) != str(key):
            raise TopologyError(f"edges into {target.name} have different keys")
        if source.name == target.name or source.name in self.reach(target.name):
            raise TopologyError(f"{source.name} -> {target.name} closes a cycle")
        self.edges.append(Edge(source.name, target.name, key))
        return target

    def successors(self, name: str) -> list[str]:
        return [e.target for e in self.edges if e.source == name]

    def predecessors(self, name: str) -> list[Edge]:
        return [e for e in self.edges if e.target == name]

    def reach(self, name: str) -> set[str]:
        found, todo = set(), [name]
        while todo:
            for n in self.successors(todo.pop()):
                if n not in found:
                    found.add(n)
                    todo.append(n)
        return found

    def roots(self) -> list[str]:
        targets = {e.target for e in self.edges}
        return sorted(n for n in self.nodes if n not in targets)

    def layers(self) -> list[list[str]]:
        """Nodes by the length of the longest path from a root."""
        depth: dict[str, int] = {}

        def of(name: str) -> int:
            if name not in depth:
                depth[name] = 1 + max((of(e.source) for e in self.predecessors(name)), default=-1)
            return depth[name]

        out: list[list[str]] = [[] for _ in range(1 + max(map(of, self.nodes), default=-1))]
        for name in sorted(self.nodes):
            out[depth[name]].append(name)
        return out

    def __str__(self) -> str:
        """Lines ``a -> b``: sources sorted, edges of a source in the order of their connection."""
        return "".join(f"{e.source} -> {e.target}\n" for e in sorted(self.edges, key=lambda e: e.source))

    def build(self) -> dict[str, DataFrame]:
        """The lazy output of every node."""
        out: dict[str, DataFrame] = {}
        for layer in self.layers():
            for name in layer:
                node, edges = self.nodes[name], self.predecessors(name)
                if node.data is not None:
                    out[name] = node.data
                    continue
                if not edges:
                    raise TopologyError(f"{name} has no input")
                df = out[edges[0].source] if len(edges) == 1 else merge(*(out[e.source] for e in edges))
                if edges[0].key is not None:
                    df = df.withColumn(KEY, edges[0].key)
                elif node.parallelism and "seq" in df.columns:  # without a key, rows are dealt in turn
                    df = round_robin(df, node.parallelism).withColumnRenamed("_partition", KEY)
                if node.parallelism:
                    df = df.repartition(node.parallelism, *([KEY] if KEY in df.columns else []))
                out[name] = node.apply(df)
        return out

    def run(self, name: str) -> DataFrame:
        return self.build()[name]
