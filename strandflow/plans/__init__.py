"""Pipelines as graphs."""

from strandflow.plans.topology import Topology, TopologyError

__all__ = ["Topology", "TopologyError"]
