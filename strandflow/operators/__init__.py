"""Operators on ordered streams.

A stream is a DataFrame; where arrival order matters, a column (``seq``) holds
it. Every order-sensitive operator takes that column, so results don't depend
on how rows are partitioned.
"""

from strandflow.operators.combine import align, dispatch, fan_out, keyed_join, merge, merge_distinct, merge_except, merge_intersect
from strandflow.operators.keyed import (
    dedupe_first,
    final_fold,
    fold_opaque,
    key_by,
    partition_of,
    round_robin,
    running_fold,
    with_partition,
)
from strandflow.operators.ordered import Cuts, EvenCuts, even_cuts, number, quantile_cuts, running
from strandflow.operators.parts import running_parts
from strandflow.operators.stateless import apply_function, flat_map, keep, map_values, pass_through
from strandflow.operators.timed import assign_time, fire, fire_each, merged_watermark, panes, watermark, windows_of

__all__ = [
    "Cuts", "EvenCuts", "align", "apply_function", "assign_time", "dedupe_first", "dispatch", "even_cuts", "fan_out", "final_fold", "fire", "fire_each", "flat_map", "fold_opaque", "keep", "key_by",
    "keyed_join", "map_values", "merge", "merge_distinct", "merge_except", "merge_intersect", "merged_watermark", "number", "panes", "partition_of", "pass_through", "quantile_cuts", "round_robin",
    "running", "running_fold", "running_parts", "watermark", "windows_of", "with_partition",
]
