"""Row-local plans on streams: projections, filters and derived columns run on a streaming DataFrame as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame

from planloom.plans.nodes import Node, Op, walk
from planloom.plans.rewrite import optimize
from planloom.plans.runtime import Context

#: Kinds of nodes that look at one row at a time.
ROW_LOCAL = frozenset({"source", "literal", "param", "item", "attribute", "text", "rename", "drop", "assign", "binary", "numeric", "udf", "row_udf", "select", "mark", "subsample"})


def on_stream(plan: Op | Node, stream: DataFrame, name: str = "stream") -> DataFrame:
    """The plan with its parameter ``name`` bound to a streaming DataFrame."""
    root = optimize(plan)
    bad = sorted({n.title() for n in walk(root) if n.kind not in ROW_LOCAL})
    if bad:
        raise ValueError(f"not row by row: {', '.join(bad)}")
    return Context(stream.sparkSession, {name: stream}).run(root).df()
