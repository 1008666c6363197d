"""Near copies by SimHash tiles and by similarity: whole texts decide every link.

Texts with one shingle set are one node. First candidates are the links of op9's tiles: texts with one fingerprint, and
fingerprints within its radius. Pairs of the similarity may be any distance apart, and the tiles give a forest, of which
whole texts may refuse links; so a prefix filter finds the rest, among texts that are not joined by then.

Shingles have an order, the same for all texts; of n shingles the first n - ceil(s n) + 1 are a text's prefix, and two
texts of similarity s or more share one of their prefixes' shingles. So no pair is lost, whatever the order; it only
decides how many texts share a shingle, and those frequent in a sample come last.
Shingles that the same texts have are one. Its candidates are first the star of each shingle's texts, then the forest that
joins all pairs which sketches of the sets allow, and then every such pair that is not joined yet; texts that are joined
are not compared again. A sketch holds parities, which differ in no more bits than the sets differ in shingles, so it can't
lose a pair. Whole texts decide every candidate, and only the texts of candidates leave their partition.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planloom.llm.common import cut, in_batches, sieve, stored
from planloom.llm.components import connected_components
from planloom.llm.simhash import fingerprint, merge, near_links, text_digest

SHINGLE = 5
SIMILARITY = 0.8
#: Bits of a sketch: a power of two in this range, at least twice the shingles if it can be.
BITS = (256, 1 << 16)
#: Of a shingle's texts, or of the texts linked to one, so many are kept in one place; more are dealt over several.
TILE = 4096
#: Pairs that are compared at a time.
BLOCK = 1 << 15
#: Texts of the sample that orders shingles, and the most of its shingles that are told apart. Any order gives the same groups.
SAMPLE = 5000
FREQUENT = 1 << 16
#: Names one text: a row's doc_id, whether it has none, and its digest.
KEY = ["key", "none", "digest"]


def shingles(text: bytes, size: int = SHINGLE) -> set[bytes]:
    """Distinct shingles of the lower-cased words; the whole sequence if it is shorter; none without words."""
    ws = text.lower().split()
    return {b" ".join(ws[i : i + size]) for i in range(max(1, len(ws) - size + 1))} if ws else set()


def _hashes(text: bytes) -> np.ndarray:
    """64 bits of each shingle, distinct and in order."""
    found = shingles(text)
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found)))


def sketch(hashes: np.ndarray) -> bytes:
    """Parities of the hashes by their upper half; of half the width they are the exclusive-or of its two halves."""
    low, high = BITS
    width = min(high, max(low, 1 << (2 * len(hashes) - 1).bit_length() if len(hashes) else low))
    return np.packbits((np.bincount((hashes >> np.uint64(32)).astype(np.int64) % width, minlength=width) & 1).astype(np.uint8)).tobytes()


def _texts(batch: pa.RecordBatch) -> Iterator[bytes]:
    return (t.as_py() or b"" for t in batch.column("text").cast(pa.binary()))


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for t in _texts(batch):
            yield pa.RecordBatch.from_arrays([pa.array(_hashes(t).view(np.int64))], ["h"])


def frequent(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, in order, of shingles that several texts of a sample have, and their counts."""
    share = min(1.0, SAMPLE / max(1, docs.count()))
    seen = in_batches(docs.select("text").sample(share, 42), _sampled, "h bigint").groupBy("h").agg(F.count("*").alias("n")).where("n > 1")
    rows = sorted((np.uint64(r["h"] & ((1 << 64) - 1)), r["n"]) for r in seen.orderBy(F.desc("n"), "h").limit(FREQUENT).collect())
    return np.array([h for h, _ in rows], np.uint64), np.array([n for _, n in rows], np.int64)


def _prefixes(known: np.ndarray, counts: np.ndarray, similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, sizes, prefixes, sketches, fps = [], [], [], [], []
            for t in _texts(batch):
                h = _hashes(t)
                length = len(h) - math.ceil(similarity * len(h) - 1e-9) + 1 if len(h) else 0
                nodes.append(xxhash.xxh3_64_intdigest(h.tobytes()))
                sizes.append(len(h))
                sketches.append(sketch(h))
                fps.append(fingerprint(t))
                if len(known):
                    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                    h = h[np.argsort(np.where(known[at] == h, counts[at], 0), kind="stable")]
                prefixes.append(h[:length].view(np.int64))
            flat = np.concatenate([*prefixes, np.empty(0, np.int64)])
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(list(map(len, prefixes)))], pa.int32()), pa.array(flat))
            columns = [*(batch.column(k) for k in KEY), pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array(sizes, pa.int64()), pa.array(sketches, pa.binary()), pa.array(np.array(fps, np.uint64).view(np.int64)), lists]
            yield pa.RecordBatch.from_arrays(columns, [*KEY, "node", "n", "sketch", "fp", "prefix"])

    return run


def forest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Places of links a[i]-b[i] that join what all of them join, without a cycle."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    label, taken, left = np.arange(len(nodes)), [], np.arange(len(a))
    while True:
        left = left[label[x[left]] != label[y[left]]]
        if not len(left):
            return np.unique(np.concatenate([*taken, np.empty(0, np.int64)]).astype(np.int64))
        ends, at = np.unique(np.concatenate([label[x[left]], label[y[left]]]), return_index=True)  # the first link of each part
        chosen = np.unique(left[at % len(left)])
        taken.append(chosen)
        label = merge(np.concatenate([x[chosen], np.arange(len(nodes))]), np.concatenate([y[chosen], label]), len(nodes))


class Sketches:
    """Rows' sketches, as a matrix for each width."""

    def __init__(self, column: pa.Array):
        flat, offsets = np.frombuffer(column.buffers()[2] or b"", np.uint8), np.frombuffer(column.buffers()[1], np.int32)[column.offset :][: len(column) + 1]
        self.bytes, starts = np.diff(offsets).astype(np.int64), offsets[:-1]
        self.place, self.rows = np.zeros(len(self.bytes), np.int64), {}
        for w in np.unique(self.bytes):
            at = np.flatnonzero(self.bytes == w)
            self.place[at] = np.arange(len(at))
            self.rows[w] = flat[starts[at][:, None] + np.arange(w)].view(np.uint64)

    def _folded(self, at: np.ndarray, wide: int, width: int) -> np.ndarray:
        found = self.rows[wide][self.place[at]]
        while wide > width:
            wide //= 2
            found = found[:, : wide // 8] ^ found[:, wide // 8 :]
        return found

    def bits(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """In how many bits the sketches of rows i[k] and j[k] differ, at the smaller of their widths."""
        out = np.zeros(len(i), np.int64)
        kinds, which = np.unique(np.stack([self.bytes[i], self.bytes[j]]), axis=1, return_inverse=True)
        for k, (x, y) in enumerate(kinds.T):
            at = np.flatnonzero(which.ravel() == k)
            step = max(1, (1 << 22) // int(min(x, y)))
            for lo in range(0, len(at), step):
                part, width = at[lo : lo + step], min(x, y)
                out[part] = np.bitwise_count(self._folded(i[part], x, width) ^ self._folded(j[part], y, width)).sum(1)
        return out


def _fine(similarity: float, small: np.ndarray, large: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Whether sets of these sizes, whose sketches differ in so many bits, may have the similarity."""
    return (np.minimum(small, large) >= similarity * np.maximum(small, large) - 1e-9) & (bits <= (1 - similarity) / (1 + similarity) * (small + large) + 1e-9)


def _allowed(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                both = Sketches(pa.concat_arrays([batch.column("sketch_a"), batch.column("sketch_b")]))
                at = np.arange(batch.num_rows)
                kept = pa.array(_fine(similarity, batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy(), both.bits(at, at + batch.num_rows)))
                yield pa.RecordBatch.from_arrays([batch.column("a").filter(kept), batch.column("b").filter(kept)], ["a", "b"])

    return run


_GROUP = ["hub", "tile", "guest", "side", "outer", "n", "node", "root"]


def _pairs(similarity: float, joined: bool):
    """Pairs of a hub's texts that are not joined yet and may be similar; if ``joined``, a forest of them.

    Rows come by hub and tile, its own before its guests. Texts outside the hub's largest root ask, all others answer.
    """

    def of(rows: pa.Table, asked: int) -> np.ndarray:
        """Pairs for the rows from ``asked`` on."""
        hub, tile, guest, side, outer, n, node, root = (rows.column(c).to_numpy() for c in _GROUP)
        sketches = Sketches(rows.column("sketch").combine_chunks())
        start = np.r_[True, (hub[1:] != hub[:-1]) | (tile[1:] != tile[:-1])]
        group = np.cumsum(start) - 1
        own = np.flatnonzero(~guest)
        span = 2 * int(n.max()) + 2
        key = group[own] * span + n[own]
        ask = np.flatnonzero(outer & (np.arange(len(n)) >= asked))
        first = np.searchsorted(key, group[ask] * span + np.ceil(similarity * n[ask] - 1e-9).astype(np.int64))
        last = np.searchsorted(key, group[ask] * span + np.minimum(np.floor(n[ask] / similarity + 1e-9).astype(np.int64), span - 1), "right")
        sizes, at, found = last - first, 0, [np.empty((2, 0), np.int64)]
        codes = np.unique(root, return_inverse=True)[1]
        label = np.arange(len(codes))  # of each group: the smallest that the forest has joined it to
        ends = np.cumsum(sizes)
        while at < len(ask):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BLOCK, "right")))
            i = np.repeat(ask[at:to], sizes[at:to])
            nth = np.arange(len(i)) - np.repeat(np.cumsum(sizes[at:to]) - sizes[at:to], sizes[at:to])
            j = own[np.repeat(first[at:to], sizes[at:to]) + nth]
            fine = (label[codes[i]] != label[codes[j]]) & (~outer[j] | np.where(guest[i], side[i] > side[j], j < i))
            i, j = i[fine], j[fine]
            bits = sketches.bits(i, j)
            fine = _fine(similarity, n[i], n[j], bits)
            i, j, bits = i[fine], j[fine], bits[fine]
            if joined and len(i):  # by the likeliest pairs
                order = np.argsort(bits / (n[i] + n[j]), kind="stable")
                i, j = i[order], j[order]
                x, y = label[codes[i]], label[codes[j]]
                keep = forest(x, y)
                i, j = i[keep], j[keep]
                label = merge(np.concatenate([x[keep], np.arange(len(label))]), np.concatenate([y[keep], label]), len(label))
            found.append(np.unique(np.stack([np.minimum(node[i], node[j]), np.maximum(node[i], node[j])]), axis=1))
            at = to
        return np.unique(np.concatenate(found, axis=1), axis=1)

    def out(pairs: np.ndarray) -> Iterator[pa.RecordBatch]:
        if pairs.shape[1]:
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, asked = None, 0  # rows of the last group and tile; those before ``asked`` have had their answers
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            hub, tile, guest = (rows.column(c).to_numpy() for c in _GROUP[:3])
            edge = np.flatnonzero((hub != hub[-1]) | (tile != tile[-1]))
            edge = int(edge[-1]) + 1 if len(edge) else 0
            if edge:
                yield from out(of(rows.slice(0, edge), asked))
                rows, asked = rows.slice(edge), 0
            own = int((~guest[edge:]).sum())
            if own < rows.num_rows:  # all of its own are here: guests get their answers and go
                yield from out(of(rows, asked))
                rows, asked = rows.slice(0, own), own
            held = rows
        if held is not None and held.num_rows:
            yield from out(of(held, asked))

    return run


def _verified(similarity: float):
    """Rows come by ``a`` and ``part``, the text of ``a`` first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, x = None, set()
        for batch in batches:
            a, b = [], []
            for at, node, own, t in zip(batch.column("a").to_pylist(), batch.column("node").to_pylist(), batch.column("own").to_pylist(), _texts(batch), strict=True):
                y = shingles(t)
                if own:
                    hub, x = at, y
                    continue
                both = len(x & y)
                if at == hub and both >= similarity * (len(x) + len(y) - both):
                    a.append(at)
                    b.append(node)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def near_pairs(prints: DataFrame) -> DataFrame:
    """(a, b) pairs of the nodes of ``prints`` (node, fp) that the tiles link: stars of equal fingerprints, and a forest of near ones."""
    marks = stored(prints.select("fp", "node").distinct(), "marks")
    heads = stored(marks.groupBy("fp").agg(F.min("node").alias("head")), "heads")
    equal = marks.join(heads, "fp").select(F.col("head").alias("x"), F.col("node").alias("y"))
    near = near_links(heads)
    for end, name in (("a", "x"), ("b", "y")):
        near = near.join(heads.select(F.col("fp").alias(end), F.col("head").alias(name)), end)
    both = equal.unionByName(near.select("x", "y"))
    return both.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def similar_groups(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, digest, root and component_id, the smallest doc_id of its group, of every row.

    Groups are the components of all pairs of texts that have the similarity. Rows without words are one group; a null doc_id
    is greater than all others; an empty table gives no rows; other columns are ignored. ``root`` tells groups apart, also
    those without a doc_id, and ``digest`` texts. Shingles and sets of shingles are told apart by 64 bits.
    """
    doc_id = F.col("doc_id").cast("bigint")
    source = docs.select(F.coalesce(doc_id, F.lit(0)).alias("key"), doc_id.isNull().alias("none"), text_digest(F.col("text")).alias("digest"), "text")
    made = stored(in_batches(source, _prefixes(*frequent(docs), similarity), "key bigint, none boolean, digest binary, node bigint, n bigint, sketch binary, fp bigint, prefix array<bigint>"), "prints")
    first = made.groupBy("node").agg(F.min(F.struct("none", "key", "digest")).alias("m"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    nodes = stored(first.select("node", "m.*", "n", "sketch"), "nodes")
    one = made.select("node", F.explode("prefix").alias("token"))
    several = one.groupBy("token").agg(F.count("*").alias("rows")).where("rows > 1").select("token")
    shared = stored(one.join(several, "token"), "shared")
    lowest = shared.groupBy("token").agg(F.min("node").alias("hub"), F.max("node").alias("last")).where("hub < last").select("token", "hub")
    # texts that share a shingle also share its hub's group
    groups = stored(shared.join(lowest, "token").select("hub", "node").distinct(), "groups")

    def linked(pairs: DataFrame) -> DataFrame:
        parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / TILE).alias("parts"))
        dealt = pairs.join(parts, "a").select("a", "b", F.pmod(F.xxhash64("b"), "parts").alias("part"))
        guests, hubs = dealt.select("a", "part", F.col("b").alias("node"), F.lit(False).alias("own")), dealt.select("a", "part", F.col("a").alias("node"), F.lit(True).alias("own")).distinct()
        asked = stored(guests.unionByName(hubs).join(nodes.select("node", *KEY), "node"), "asked")
        texts = sieve(source, KEY, asked).groupBy(*KEY).agg(F.first("text").alias("text"))
        rows = texts.join(asked, KEY).select("a", "part", "own", "node", "text").repartition("a", "part").sortWithinPartitions("a", "part", F.desc("own"))
        return stored(in_batches(rows, _verified(similarity), "a bigint, b bigint"), "links")

    def rooted(links: DataFrame) -> DataFrame:
        return stored(nodes.select("node").join(connected_components(links), "node", "left").select("node", F.coalesce("root", "node").alias("root")), "roots")

    def pairs(roots: DataFrame, joined: bool) -> DataFrame:
        now = groups.join(roots, "node")
        # a group whose texts are joined gives no further pair
        several = now.groupBy("hub", "root").agg(F.count("*").alias("size")).groupBy("hub").agg(F.max(F.struct("size", "root")).alias("main"), F.sum("size").alias("texts"), F.count("*").alias("roots")).where("roots > 1")
        dealt = now.join(stored(several.select("hub", F.col("main.root").alias("main"), F.ceil(F.col("texts") / TILE).cast("int").alias("tiles")), "hubs"), "hub")
        dealt = dealt.withColumn("side", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int")).withColumn("outer", F.expr("root <> main"))
        dealt = dealt.withColumn("tile", F.explode(F.expr("CASE WHEN outer THEN sequence(0, tiles - 1) ELSE array(side) END"))).withColumn("guest", F.expr("tile <> side"))
        dealt = dealt.join(nodes.select("node", "n", "sketch"), "node").select(*_GROUP, "sketch").repartition("hub", "tile").sortWithinPartitions("hub", "tile", "guest", "n", "node")
        return stored(in_batches(dealt, _pairs(similarity, joined), "a bigint, b bigint").distinct(), "pairs")

    def allowed(pairs: DataFrame) -> DataFrame:
        for end in "ab":
            pairs = pairs.join(nodes.select(F.col("node").alias(end), F.col("n").alias(f"n_{end}"), F.col("sketch").alias(f"sketch_{end}")), end)
        pairs = pairs.where(F.least("n_a", "n_b") >= similarity * F.greatest("n_a", "n_b") - 1e-9)
        return stored(in_batches(pairs, _allowed(similarity), "a bigint, b bigint"), "allowed")

    links = linked(allowed(near_pairs(made)))
    roots = rooted(links)
    stars = groups.where("node > hub").join(roots, "node").join(roots.select(F.col("node").alias("hub"), F.col("root").alias("main")), "hub")
    stars = stars.where("root <> main").select(F.col("hub").alias("a"), F.col("node").alias("b"))
    links = stored(links.unionByName(linked(allowed(stars))), "links")
    joins = pairs(rooted(links), True)
    held = linked(joins)
    links = stored(links.unionByName(held), "links")
    failed = joins.join(held, ["a", "b"], "left_anti").select(F.col("a").alias("node"))
    # what the forest joined by links that all hold is done; where one failed, each pair is asked for
    whole = rooted(links.unionByName(joins))
    open_ = whole.join(whole.join(failed, "node").select("root").distinct(), "root", "left_semi").select("node")
    links = links.unionByName(linked(pairs(rooted(links).join(open_, "node", "left_semi"), False)))
    roots = rooted(links)
    named = nodes.join(roots, "node").groupBy("root").agg(F.min(F.when(~F.col("none"), F.col("key"))).alias("component_id"))
    labelled = cut(roots.join(named, "root"))
    return made.select("node", *KEY).join(labelled, "node").select(F.when(~F.col("none"), F.col("key")).alias("doc_id"), "digest", "root", "component_id")
