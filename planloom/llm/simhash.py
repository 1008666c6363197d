"""SimHash near-dedup by tiled exact comparison.

Distinct fingerprints are laid into tiles by the population counts of their four 16-bit lanes. Two fingerprints within
the radius differ by at most the radius in the summed differences of these counts, so tile pairs beyond it are skipped;
every other pair of tiles is compared exactly, in numpy blocks of exclusive-or and bit counts. A tile travels as one row,
its fingerprints in an array, and only to tiles whose counts are within the radius and not before its own. Tiles have a
fixed size, so a large group of near copies is dealt over many. Within a tile matches are joined into a forest, so the links that leave it grow with the
fingerprints and not with the pairs. Exact copies share one fingerprint and are never compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planloom.llm.common import cut, in_batches, numbered, sieve, stored
from planloom.llm.components import connected_components

SHINGLE = 3
RADIUS = 3
SEED = 42
#: Fingerprints of a tile.
TILE = 4096
#: Fingerprints of the other side that are compared at a time.
BLOCK = 256
LANES = 4
#: A lane has 0 to 16 bits set, so there are 17 ** 4 populations at most, whatever the input.
_BASE = 64 // LANES + 1


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """64 bits, each 1 if set in over half the hashes of the shingles, repeats included."""
    ws = text.lower().split()
    if not ws:
        return 0
    line = b" ".join(ws)
    sizes = np.fromiter(map(len, ws), np.int64, len(ws))
    ends = np.cumsum(sizes + 1) - 1
    n = max(1, len(ws) - shingle + 1)
    starts, ends = (ends - sizes)[:n].tolist(), ends[len(ws) - n :].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(line[a:b], SEED) for a, b in zip(starts, ends, strict=True)), np.uint64, n)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        part = hashes[at : at + (1 << 16)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = np.fromiter((fingerprint(t or b"") for t in batch.column("text").cast(pa.binary()).to_pylist()), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("digest"), pa.array(fps.view(np.int64))], ["doc_id", "digest", "fp"])


def text_digest(text: Column) -> Column:
    """128 bits that tell texts apart; null is as empty."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, fp) of every row; without words fp is 0."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_digest(F.col("text")).alias("digest"), "text")
    return in_batches(rows, _fingerprints, "doc_id bigint, digest binary, fp bigint")


def merge(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest node of each node's component, for the links a[i]-b[i] of nodes 0 to n - 1."""
    label = np.arange(n)
    while len(a):
        low, high = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
        apart = low != high
        if not apart.any():
            break
        np.minimum.at(label, high[apart], low[apart])
        while (label[label] != label).any():
            label = label[label]
        a, b = a[apart], b[apart]
    return label


class Tile:
    """One tile; takes its own fingerprints first and then those of others, and gives the links of a forest."""

    def __init__(self, radius: int):
        self.radius, self.parts, self.own, self.label = radius, [], None, None

    def _block(self, others: np.ndarray, first: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Links of up to BLOCK fingerprints with the tile; ``first`` is the place of the first one if it is in the tile."""
        near = np.bitwise_count(others[:, None] ^ self.own[None, :]) <= self.radius
        k, i = np.nonzero(near)
        if not len(k):
            return np.empty(0, np.uint64), np.empty(0, np.uint64)
        n = len(self.own)
        if first is not None:
            self.label = merge(np.concatenate([k + first, np.arange(n)]), np.concatenate([i, self.label]), n)
            return np.empty(0, np.uint64), np.empty(0, np.uint64)
        old = self.label
        both = merge(np.concatenate([k + n, np.arange(n)]), np.concatenate([i, old]), n + len(others))
        hit = np.unique(k)
        moved = np.flatnonzero((both[:n] != old) & (old == np.arange(n)))
        self.label = both[:n]
        return np.concatenate([others[hit], self.own[moved]]), np.concatenate([self.own[both[n + hit]], self.own[both[moved]]])

    def links(self, fps: np.ndarray, own: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if own:
            self.parts.append(fps)
            return
        yield from self.close()
        for at in range(0, len(fps), BLOCK):
            yield self._block(fps[at : at + BLOCK], None)

    def close(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Compares the tile with itself, once all of its own have come."""
        if self.own is None:
            self.own = np.concatenate([*self.parts, np.empty(0, np.uint64)])
            self.label = np.arange(len(self.own))
            for at in range(0, len(self.own), BLOCK):
                self._block(self.own[at : at + BLOCK], at)
            apart = np.flatnonzero(self.label != np.arange(len(self.own)))
            yield self.own[apart], self.own[self.label[apart]]


def _compare(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, held = None, None

        def out(found):
            for a, b in found:
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        for batch in batches:
            tiles, guests = batch.column("tile").to_numpy(), batch.column("guest").to_numpy(zero_copy_only=False)
            fps = batch.column("fps").flatten().to_numpy().view(np.uint64)
            past = np.concatenate([[0], np.cumsum(pc.list_value_length(batch.column("fps")).to_numpy())])
            edges = np.flatnonzero(np.r_[True, (tiles[1:] != tiles[:-1]) | (guests[1:] != guests[:-1]), True]) if len(tiles) else []
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                if tiles[lo] != tile:
                    if held:
                        yield from out(held.close())
                    tile, held = tiles[lo], Tile(radius)
                yield from out(held.links(fps[past[lo] : past[hi]], own=not guests[lo]))
        if held:
            yield from out(held.close())

    return run


def _moves(radius: int) -> list[list[int]]:
    """Steps from a population to those after it within the radius."""
    reach = range(-radius, radius + 1)
    return [list(d) for d in product(reach, repeat=LANES) if sum(map(abs, d)) <= radius and d > (0,) * LANES]


def near_links(fps: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """(a, b) links between the distinct values of ``fp``: a forest of the pairs that differ in ``radius`` bits or fewer."""
    width = 64 // LANES
    lanes = [F.bit_count(F.shiftrightunsigned("fp", width * k).bitwiseAND((1 << width) - 1)) for k in range(LANES)]
    bucket = lambda ps: sum((p * _BASE**k for k, p in enumerate(ps[1:], 1)), ps[0])
    spark = fps.sparkSession
    laid = stored(fps.select("fp").distinct().select("fp", F.array(*lanes).alias("pops")).withColumn("bucket", bucket([F.col("pops")[k] for k in range(LANES)])), "fingerprints")
    counts = sorted((r["bucket"], r["count"]) for r in laid.groupBy("bucket").count().collect())  # 17 ** 4 rows at most
    sized, first = [], 0
    for b, n in counts:
        sized.append((b, first, -(-n // tile)))
        first += sized[-1][2]
    known = F.broadcast(spark.createDataFrame(sized, "bucket int, first bigint, tiles bigint"))
    placed = laid.join(known, "bucket").withColumn("tile", F.col("first") + F.pmod(F.xxhash64("fp"), F.col("tiles")))
    home = stored(placed.groupBy("tile", "first", "tiles").agg(F.first("pops").alias("pops"), F.collect_list("fp").alias("fps")), "tiles")
    home = home.repartition(2 * spark.sparkContext.defaultParallelism, "tile")
    own = home.select("tile", F.lit(False).alias("guest"), "fps")
    same = home.where("tiles > 1 and tile < first + tiles - 1").select(F.explode(F.expr("sequence(tile + 1, first + tiles - 1)")).alias("tile"), F.lit(True).alias("guest"), "fps")
    steps = F.array(*[F.array(*map(F.lit, d)) for d in _moves(radius)])
    moved = home.select("fps", F.explode(F.transform(steps, lambda d: F.zip_with("pops", d, lambda p, x: p + x))).alias("to"))
    moved = moved.where(F.forall("to", lambda p: p.between(0, width))).select("fps", bucket([F.col("to")[k] for k in range(LANES)]).alias("bucket"))
    near = moved.join(known, "bucket").select(F.explode(F.expr("sequence(first, first + tiles - 1)")).alias("tile"), F.lit(True).alias("guest"), "fps")
    dealt = own.unionByName(same).unionByName(near).repartition("tile").sortWithinPartitions("tile", "guest")
    return in_batches(dealt, _compare(radius), "a bigint, b bigint")


def near_groups(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, digest, fp, root, component_id of every row; component_id is the smallest doc_id that links reach, root the smallest fp.

    Rows without words, null and empty texts among them, have fingerprint zero and are linked like any other. A null doc_id
    is greater than all others, and is a component's id only if there is no other. Repeated rows are in one component; an
    empty table gives no rows; other columns are ignored.
    """
    prints = stored(fingerprints(docs), "prints")
    least = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "least")
    roots = connected_components(near_links(prints)).withColumnRenamed("node", "fp")
    rooted = stored(least.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "rooted")
    ids = stored(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "ids")
    labelled = cut(rooted.join(ids, "root").select("fp", "root", "component_id"))
    return prints.join(labelled, "fp").select("doc_id", "digest", "fp", "root", "component_id")


def fingerprint_digests(docs: DataFrame) -> DataFrame:
    """near_groups() with the fingerprint as 16 hex digits."""
    return near_groups(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """One document of each group, by default of near_groups: the row with its smallest doc_id. All columns stay.

    A group is told by its ``root`` and a row by doc_id and text, so groups whose smallest doc_id is null or repeated are
    kept apart. Of a group's rows that repeat that doc_id one stays.
    """
    groups = near_groups(docs) if groups is None else groups
    cells = groups.groupBy("root", F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("key"), "digest").agg(F.count("*").alias("rows"))
    cells = stored(cells, "cells")
    keep = cells.groupBy("root").agg(F.min(F.struct("none", "key", "digest", "rows")).alias("m")).select("m.*")
    key = ["none", "key", "digest"]
    lost = stored(cells.join(keep.select(*key, F.lit(True).alias("kept")), key, "left").where("kept is null or rows > 1").select(*key, "kept"), "lost")
    inner, at = numbered(docs)
    doc_id = F.col(at["doc_id"]).cast("bigint")
    rows = inner.withColumn("none", doc_id.isNull()).withColumn("key", F.coalesce(doc_id, F.lit(0))).withColumn("digest", text_digest(F.col(at["text"])))
    # most rows are neither lost nor repeated and stay where they are
    judged = sieve(rows, key, lost).join(lost, key, "left_anti")
    several = sieve(rows, key, lost).join(lost.where("kept").select(*key), key, "left_semi").dropDuplicates(key)
    return sieve(rows, key, lost, inside=False).unionByName(judged).unionByName(several).select(*inner.columns).toDF(*docs.columns)
