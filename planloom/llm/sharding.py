"""Consistent-hash ring with virtual nodes and bounded loads, in DataFrame operations only.

A key goes clockwise to the next virtual node on a 32-bit ring. Loads are bounded: a shard takes rows up to its
capacity, and the rows beyond it continue clockwise to the next virtual nodes whose shards have room. Only the number
of rows in each part of an arc (``shards * vnodes * PARTS`` numbers, whatever the input) reaches the driver. There the walk
is done arc by arc; it yields intervals of ranks within an arc, which a broadcast of that bounded plan turns into a shard
and a slot for each row. Rows of one key are spread over the parts of its arc, and equal rows are counted, not ranked, so no
key makes one task.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from planloom.llm.common import stored

#: Virtual nodes of each shard. Arcs are also the unit of parallel ranking.
VNODES = 128
#: Parts of an arc, which are ranked apart; rows go to them by their text's size and checksum.
PARTS = 64
#: Equal rows that one task puts out at a time.
RUN = 1 << 16
#: Top bits of the ring position by which the virtual nodes are looked up.
LOOKUP_BITS = 12


def ring_position(key: str) -> int:
    """Position of a key's text on the 32-bit ring."""
    return int(hashlib.md5(key.encode()).hexdigest()[:8], 16)


def ring(shards: int, vnodes: int = VNODES) -> list[tuple[int, int]]:
    """(position, shard) of the virtual nodes in clockwise order; equal positions keep the smallest shard."""
    nodes: dict[int, int] = {}
    for s in range(shards):
        for v in range(vnodes):
            nodes.setdefault(ring_position(f"shard {s} node {v}"), s)
    return sorted(nodes.items())


def capacities(rows: int, shards: int, slack: float = 0.0) -> list[int]:
    """Rows each shard may take: with no slack they add up to ``rows`` and differ by one at most."""
    if slack <= 0:
        return [rows // shards + (s < rows % shards) for s in range(shards)]
    return [-(-int(rows * (1 + slack) * 1_000_000) // (shards * 1_000_000)) + 1] * shards


def walk(counts: dict[int, int], nodes: list[tuple[int, int]], caps: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(arc, first rank, rank after the last, shard, first slot) for all rows of all arcs.

    Every shard first takes its own arcs in ring order up to its capacity. What is left of an arc continues clockwise.
    """
    free, used = list(caps), [0] * len(caps)
    plan, over = [], []

    def take(arc: int, at: int, left: int, shard: int) -> int:
        n = min(left, free[shard])
        if n:
            plan.append((arc, at, at + n, shard, used[shard]))
            free[shard] -= n
            used[shard] += n
        return n

    for arc, (_, shard) in enumerate(nodes):
        n = counts.get(arc, 0)
        got = take(arc, 0, n, shard)
        if got < n:
            over.append((arc, got, n - got))
    for arc, at, left in over:
        step = arc
        while left:
            step = (step + 1) % len(nodes)
            got = take(arc, at, left, nodes[step][1])
            at, left = at + got, left - got
    return plan


def _lookup(nodes: list[tuple[int, int]]) -> list[tuple[int, list[tuple[int, int]]]]:
    """For each value of the top bits: the virtual nodes there as (position, arc), and the next one clockwise."""
    places, width, out = [p for p, _ in nodes], 32 - LOOKUP_BITS, []
    for b in range(1 << LOOKUP_BITS):
        lo, hi = bisect_left(places, b << width), bisect_left(places, (b + 1) << width)
        out.append((b, [*((places[i], i) for i in range(lo, hi)), (1 << 32, hi % len(nodes))]))
    return out


def assign_shards(docs: DataFrame, shards: int = 24, vnodes: int = VNODES, slack: float = 0.0) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row.

    Law ``rows``: with no slack the counts of the shards are at most one apart. A null doc_id is the key ``null``; a null
    text has no bytes; repeated rows are rows of their own, and those of equal size and checksum are alike; an empty table
    gives no rows; other columns are ignored. An arc's rows are in order of part, ring position, doc_id, size and checksum.
    """
    spark = docs.sparkSession
    nodes = ring(shards, vnodes)
    arcs = F.broadcast(spark.createDataFrame(_lookup(nodes), "top int, nodes array<struct<pos: bigint, arc: int>>"))
    place = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).cast("binary")), 1, 8), 16, 10).cast("bigint")

    def on_ring(df: DataFrame) -> DataFrame:
        placed = df.withColumn("pos", place).withColumn("top", F.shiftright("pos", 32 - LOOKUP_BITS).cast("int")).join(arcs, "top")
        return placed.withColumn("arc", F.filter("nodes", lambda x: x["pos"] >= F.col("pos"))[0]["arc"]).drop("nodes", "top")

    text = F.coalesce(F.col("text"), F.lit(""))
    rows = on_ring(docs.select(F.col("doc_id"), (F.octet_length(text) + 8).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")))
    row = ["pos", "doc_id", "size", "text_crc32"]
    equal = stored(rows.groupBy("arc", F.pmod(F.col("text_crc32") + F.col("size"), F.lit(PARTS)).cast("int").alias("part"), *row).agg(F.count("*").alias("copies")), "rows")
    parts: dict[int, list[int]] = {}
    for r in equal.groupBy("arc", "part").agg(F.sum("copies").alias("n")).collect():
        parts.setdefault(r["arc"], [0] * PARTS)[r["part"]] = r["n"]
    counts = {arc: sum(n) for arc, n in parts.items()}
    pieces: dict[int, list] = {arc: [] for arc in counts}
    for arc, *rest in walk(counts, nodes, capacities(sum(counts.values()), shards, slack)):
        pieces[arc].append(tuple(rest))
    plan = [(arc, [0, *accumulate(parts[arc])], pieces[arc]) for arc in sorted(parts)]
    planned = F.broadcast(spark.createDataFrame(plan, "arc int, before array<bigint>, pieces array<struct<first: bigint, end: bigint, shard: int, slot: bigint>>"))

    upto = F.sum("copies").over(Window.partitionBy("arc", "part").orderBy(*row).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = equal.withColumn("first", upto - F.col("copies")).join(planned, "arc").withColumn("first", F.col("first") + F.get("before", "part"))
    few, many = ranked.where(F.col("copies") <= RUN), ranked.where(F.col("copies") > RUN)
    runs = many.withColumn("at", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("copies") - 1, F.lit(RUN).cast("bigint")))).repartition("first", "at")
    runs = runs.withColumn("first", F.col("first") + F.col("at")).withColumn("copies", F.least(F.lit(RUN), F.col("copies") - F.col("at"))).drop("at")
    each = few.unionByName(runs).withColumn("rank", F.explode(F.expr("sequence(first, first + copies - 1)")))
    piece = F.filter("pieces", lambda x: (x["first"] <= F.col("rank")) & (F.col("rank") < x["end"]))[0]
    return each.withColumn("piece", piece).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("piece.shard").alias("shard"),
        (F.col("piece.slot") + F.col("rank") - F.col("piece.first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
