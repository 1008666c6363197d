"""Connected components of links in a table, by alternating large-star and small-star contraction.

Every round is aggregations and joins; a star's centre may have any number of leaves, since only minima are grouped and
the joins read checkpointed tables, whose large partitions adaptive execution can split. Partitions follow the number of
links, so that a few links don't make the session's number of tasks and files in each of the steps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planloom.llm.common import cut

#: Links of a partition.
LINKS = 1 << 17


def _star(edges: DataFrame, large: bool, parts: int) -> DataFrame:
    """edges: (u, v) with u > v. Links neighbours to the smallest neighbour of each node."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")).coalesce(parts))
    far = both.where("v > u") if large else both
    linked = far.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).coalesce(parts)
    if not large:  # the node itself goes to its smallest neighbour too
        linked = linked.unionByName(least.select("u", F.col("m").alias("v")))
    return linked.where("u > v").distinct() if not large else linked.where("u > v").unionByName(least.where("u > m").select("u", F.col("m").alias("v"))).distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root) for the nodes of ``links`` (a, b); a component's root is its smallest node."""
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct())
    sign = None
    while True:
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
        if (now["n"], now["h"]) == sign or not now["n"]:
            break
        sign, parts = (now["n"], now["h"]), -(-now["n"] // LINKS)
        for large in (True, False):
            edges = cut(_star(edges.coalesce(parts), large, parts).coalesce(parts))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
