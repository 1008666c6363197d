"""Reversible line dedup: sharded cuckoo filters in front of exact reference-count tables.

Each distinct line key of a document is a 128-bit hash; such (key, document) references are the exact record, kept as
Parquet. Every shard of the keys has a cuckoo filter (two bytes a slot). Inserted keys stream through the filter of
their shard: a key whose fingerprint is already there is a suspect; all others are certainly new. Only suspects go to
the exact reference counts, so the singletons, which are most lines, are never counted or joined. False positives of
the filter are resolved there. Deleting documents removes their references, and removes from the filters those
fingerprints that no remaining key shares, so an insertion and its deletion leave the same answers as neither.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planloom.llm.common import in_batches, numbered, sieve, stored

#: Shortest key, in code points, that is deduplicated.
MIN_CHARS = 10
#: Keys for which each shard's filter is laid out; more keys open a further table in the shard.
KEYS_PER_SHARD = 1 << 19
#: Stands for a null doc_id: one document after all others.
NO_ID = (1 << 63) - 1
#: Hashes that are reduced together before they are sent.
KEYS_AT_A_TIME = 1 << 17
SLOTS = 4
_MIX = 0x5BD1E995

REFS = "doc bigint, hi bigint, lo bigint"
FILTERS = "shard int, blob binary"


def line_key(line: bytes) -> bytes:
    """ASCII white space stripped, A-Z lower-cased."""
    return line.strip().lower()


def counts_as_key(key: bytes, min_chars: int = MIN_CHARS) -> bool:
    return len(key) >= min_chars and (len(key) >= 4 * min_chars or len(key.decode()) >= min_chars)


def _digest(key: bytes) -> bytes:
    return xxhash.xxh3_128_digest(key)


def _texts(batch: pa.RecordBatch, name: str) -> Iterator[bytes]:
    return (t.as_py() for t in batch.column(name).cast(pa.binary()))


def _references(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        docs, found = [], []
        for doc, text in zip(batch.column("doc").to_pylist(), _texts(batch, "text"), strict=True):
            own = {_digest(k) for k in map(line_key, text.split(b"\n")) if counts_as_key(k)}
            docs.append(np.full(len(own), doc, np.int64))
            found.extend(sorted(own))
        keys = np.frombuffer(b"".join(found), np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*docs, np.empty(0, np.int64)])), pa.array(keys[:, 0].copy()), pa.array(keys[:, 1].copy())], ["doc", "hi", "lo"])


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("doc"), F.coalesce("text", F.lit("")).alias("text"))


class CuckooFilter:
    """A set of 16-bit fingerprints, four to a bucket, each in one of two buckets. It grows by further tables."""

    def __init__(self, buckets: int, tables: list[np.ndarray] | None = None):
        self.buckets, self.tables = buckets, tables or [np.zeros((buckets, SLOTS), np.uint16)]

    @staticmethod
    def codes(keys: np.ndarray, buckets: int) -> np.ndarray:
        """fingerprint << 32 | the smaller of the two buckets."""
        u = keys.astype(np.int64).view(np.uint64)
        mark = (u >> np.uint64(48)).astype(np.int64)
        mark[mark == 0] = 1
        first = (u & np.uint64(buckets - 1)).astype(np.int64)
        return mark << 32 | np.minimum(first, first ^ (mark * _MIX & buckets - 1))

    def _places(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mark, first = codes >> 32, codes & 0xFFFFFFFF
        return mark.astype(np.uint16), first, first ^ (mark * _MIX & self.buckets - 1)

    def contains(self, codes: np.ndarray) -> np.ndarray:
        mark, one, two = self._places(codes)
        found = np.zeros(len(codes), bool)
        for t in self.tables:
            found |= (t[one] == mark[:, None]).any(1) | (t[two] == mark[:, None]).any(1)
        return found

    def insert(self, codes: np.ndarray) -> None:
        """Adds the codes, each once."""
        left = np.unique(codes)
        left = left[~self.contains(left)]
        k = 0
        while len(left):
            if k == len(self.tables):
                self.tables.append(np.zeros((self.buckets, SLOTS), np.uint16))
            left = self._fill(self.tables[k], left)
            k += 1

    def _fill(self, table: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Puts what fits into one table and returns the rest."""
        for side in (1, 2):
            places = self._places(codes)
            mark, at = places[0], places[side]
            order = np.argsort(at, kind="stable")
            at, mark, codes = at[order], mark[order], codes[order]
            start = np.r_[True, at[1:] != at[:-1]] if len(at) else np.empty(0, bool)
            rank = np.arange(len(at)) - np.maximum.accumulate(np.where(start, np.arange(len(at)), 0))
            empty = table[at] == 0
            fits = rank < empty.sum(1)
            slot = np.argmax(np.cumsum(empty, 1) > rank[:, None], 1)
            table[at[fits], slot[fits]] = mark[fits]
            codes = codes[~fits]
        return codes[[not self._kick(table, int(c)) for c in codes]] if len(codes) else codes

    def _kick(self, table: np.ndarray, code: int, most: int = 200) -> bool:
        """Moves fingerprints to their other buckets until there is room; undone if there is none."""
        mark, at, trail = code >> 32, code & 0xFFFFFFFF, []
        for n in range(most):
            row = table[at]
            free = np.flatnonzero(row == 0)
            if len(free):
                row[free[0]] = mark
                return True
            slot = (n + mark) % SLOTS
            trail.append((at, slot, int(row[slot])))
            mark, row[slot] = int(row[slot]), mark
            at ^= mark * _MIX & self.buckets - 1
        for at, slot, old in reversed(trail):
            table[at][slot] = old
        return False

    def remove(self, codes: np.ndarray) -> None:
        mark, one, two = self._places(np.unique(codes))
        for t in self.tables:
            for at in (one, two):
                row, slot = np.nonzero(t[at] == mark[:, None])
                t[at[row], slot] = 0

    def to_bytes(self) -> bytes:
        return np.stack(self.tables).tobytes()

    @classmethod
    def from_bytes(cls, blob: bytes, buckets: int) -> CuckooFilter:
        return cls(buckets, list(np.frombuffer(blob, np.uint16).reshape(-1, buckets, SLOTS).copy()))


def _per_shard(buckets: int, dead: bool):
    """Streams rows (shard, blob, hi), sorted by shard with the shard's filter first, through the filters.

    Yields the hashes that were there already, and each shard's new filter.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held = None, None

        def row(shard, blob, his):
            n = max(len(his), 1) if blob is not None else len(his)
            return pa.RecordBatch.from_arrays([pa.array(np.full(n, shard, np.int32)), pa.array([blob] * n if blob is not None else [None] * n, pa.binary()), pa.array(his if blob is None else [None], pa.int64())], ["shard", "blob", "hi"])

        for batch in batches:
            shards, his = batch.column("shard").to_numpy(), batch.column("hi")
            edges = np.flatnonzero(np.r_[True, shards[1:] != shards[:-1], True])
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                if shards[lo] != shard:
                    if held:
                        yield row(shard, held.to_bytes(), [])
                    shard, held = int(shards[lo]), CuckooFilter(buckets)
                part = his.slice(lo, hi - lo)
                if part.null_count:
                    held = CuckooFilter.from_bytes(batch.column("blob").slice(lo, 1).to_pylist()[0], buckets)
                    part = part.drop_null()
                keys, counts = np.unique(part.to_numpy(zero_copy_only=False).astype(np.int64), return_counts=True)
                codes = CuckooFilter.codes(keys, buckets)
                if dead:
                    held.remove(codes)
                    continue
                _, back, shared = np.unique(codes, return_inverse=True, return_counts=True)
                known = held.contains(codes) | (counts > 1) | (shared[back] > 1)
                held.insert(codes)
                if known.any():
                    yield row(shard, None, keys[known])
        if held:
            yield row(shard, held.to_bytes(), [])

    return run


def _unique_in_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Map-side reduction: a hash found several times in a batch is sent twice, which is enough to make it a suspect."""
    for batch in batches:
        keys, counts = np.unique(batch.column("hi").to_numpy(zero_copy_only=False), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(keys, np.minimum(counts, 2)))], ["hi"])


@dataclass(frozen=True)
class LineIndex:
    """An immutable state of the index; insert() and delete() return the next one.

    references: (doc, hi, lo), each distinct key of each document row. filters: (shard, blob). suspects: (hi), the hashes
    that may have two references or more.
    """

    spark: SparkSession
    shards: int
    buckets: int
    references: DataFrame
    filters: DataFrame
    suspects: DataFrame

    @classmethod
    def empty(cls, spark: SparkSession, expected_keys: int, keys_per_shard: int = KEYS_PER_SHARD) -> LineIndex:
        """Shards follow the expected keys, so that a filter stays a few megabytes at any size."""
        shards = max(1, -(-expected_keys // keys_per_shard))
        buckets = 1 << max(4, (min(keys_per_shard, expected_keys) * 5 // (4 * SLOTS)).bit_length())
        none = lambda schema: spark.createDataFrame([], schema)
        return cls(spark, shards, buckets, none(REFS), none(FILTERS), none("hi bigint"))

    @classmethod
    def of(cls, docs: DataFrame) -> LineIndex:
        """An index of all lines of ``docs``."""
        found = references(docs)
        return cls.empty(docs.sparkSession, found.count())._insert(found)

    def insert(self, docs: DataFrame) -> LineIndex:
        """Adds documents. The references of earlier ones are not read again."""
        return self._insert(references(docs))

    def _shard(self):
        return F.pmod(F.col("hi"), F.lit(self.shards)).cast("int").alias("shard")

    def _stream(self, his: DataFrame, dead: bool) -> DataFrame:
        rows = his.select(self._shard(), F.lit(None).cast("binary").alias("blob"), "hi")
        rows = self.filters.select("shard", "blob", F.lit(None).cast("bigint").alias("hi")).unionByName(rows)
        dealt = rows.repartition(max(self.shards, 1), "shard").sortWithinPartitions("shard", "hi")  # nulls, the filter, come first
        return stored(in_batches(dealt, _per_shard(self.buckets, dead), "shard int, blob binary, hi bigint"), "cuckoo")

    def _insert(self, found: DataFrame) -> LineIndex:
        out = self._stream(in_batches(found.select("hi"), _unique_in_batch, "hi bigint", KEYS_AT_A_TIME), dead=False)
        return LineIndex(
            self.spark, self.shards, self.buckets, self.references.unionByName(found),
            out.where("blob is not null").select("shard", "blob"), self.suspects.unionByName(out.where("blob is null").select("hi")),
        )

    def delete(self, doc_ids: DataFrame) -> LineIndex:
        """Removes the documents whose doc_id is in ``doc_ids``."""
        gone = doc_ids.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("doc")).distinct()
        live = stored(self.references.join(gone, "doc", "left_anti"), "references")
        dead = self.references.join(gone, "doc", "left_semi")
        mark = F.greatest(F.shiftrightunsigned("hi", 48), F.lit(1))
        first = F.col("hi").bitwiseAND(self.buckets - 1)
        code = F.struct(self._shard(), mark.alias("mark"), F.least(first, first.bitwiseXOR((mark * _MIX).bitwiseAND(self.buckets - 1))).alias("at"))
        only = dead.select("hi", code.alias("code")).join(live.select(code.alias("code")), "code", "left_anti").select("hi")
        out = self._stream(only, dead=True)
        return LineIndex(self.spark, self.shards, self.buckets, live, out.where("blob is not null").select("shard", "blob"), self.suspects)

    def may_contain(self, docs: DataFrame) -> DataFrame:
        """Hashes of ``docs`` that the filters have seen: all that are in the index and a few others."""
        out = self._stream(in_batches(references(docs).select("hi"), _unique_in_batch, "hi bigint", KEYS_AT_A_TIME), dead=False)
        return out.where("blob is null").select("hi").distinct()

    def _suspected(self) -> DataFrame:
        return stored(self.references.join(self.suspects.distinct(), "hi", "left_semi"), "suspected")

    def counts(self) -> DataFrame:
        """(hi, lo, refs, first_doc, last_doc): the exact reference counts of keys that two documents or more have."""
        return self._count(self._suspected())

    @staticmethod
    def _count(suspected: DataFrame) -> DataFrame:
        counted = suspected.groupBy("hi", "lo").agg(F.count("*").alias("refs"), F.min("doc").alias("first_doc"), F.max("doc").alias("last_doc"))
        return counted.where("first_doc < last_doc")

    def drops(self) -> DataFrame:
        """(doc, keys): the digests whose lines a document loses, since a smaller doc_id has them."""
        suspected = self._suspected()
        repeated = stored(self._count(suspected).select("hi", "lo", "first_doc"), "counts")
        lost = suspected.join(repeated, ["hi", "lo"]).where("doc > first_doc")
        return stored(lost.groupBy("doc").agg(F.collect_set(F.struct("hi", "lo")).alias("keys")), "drops")


def references(docs: DataFrame) -> DataFrame:
    """(doc, hi, lo): one row for each document row and distinct key in it."""
    return stored(in_batches(_keyed(docs), _references, REFS), "references")


def _kept(batch: pa.RecordBatch, text_name: str) -> Iterator[tuple[bytes | None, int, int]]:
    """(text that is left, its lines before, lines dropped) of each row."""
    for row, keys in zip(batch.column(text_name).cast(pa.binary()), batch.column("keys"), strict=True):
        text = row.as_py()
        lines = kept = (text or b"").split(b"\n")
        if keys.is_valid:
            pairs = np.stack([keys.values.field(k).to_numpy() for k in ("hi", "lo")], axis=1)
            lost = set(pairs.astype(np.int64).view("V16").ravel().tolist())
            kept = [x for x in lines if not (counts_as_key(k := line_key(x)) and _digest(k) in lost)]
        yield text if len(kept) == len(lines) else b"\n".join(kept), len(lines), len(lines) - len(kept)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [(n, d, hashlib.sha256(x or b"").hexdigest()) for x, n, d in _kept(batch, "text")]
        n_lines, n_dropped, sha = zip(*found, strict=True) if found else ((), (), ())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(sha, pa.string())], ["doc_id", "n_lines", "n_dropped", "kept_sha256"])


def _rewrite(inner: list[str], text: str, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = pa.array([x for x, _, _ in _kept(batch, text)], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([kept if c == text else batch.column(c) for c in inner], names)

    return run


def _with_drops(rows: DataFrame, doc_id: str, drops: DataFrame) -> DataFrame:
    """``rows`` with the keys they lose; texts that lose none stay where they are."""
    rows = rows.withColumn("doc", F.coalesce(F.col(doc_id).cast("bigint"), F.lit(NO_ID)))
    untouched = sieve(rows, ["doc"], drops, inside=False).withColumn("keys", F.lit(None).cast(drops.schema["keys"].dataType))
    return sieve(rows, ["doc"], drops).join(drops, "doc", "left").unionByName(untouched).drop("doc")


def line_digests(docs: DataFrame, index: LineIndex | None = None) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of every row.

    A null or empty text is one empty line, which is no key. Rows that repeat a doc_id are one document, so a line is never
    lost to a row of its own document. Null doc_ids are one document after all others. Other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    joined = _with_drops(rows, "doc_id", (index or LineIndex.of(docs)).drops())
    return in_batches(joined, _digests, "doc_id bigint, n_lines bigint, n_dropped bigint, kept_sha256 string")


def drop_repeated_lines(docs: DataFrame, index: LineIndex | None = None) -> DataFrame:
    """``docs`` with the repeated lines taken out of ``text``; all other columns and all rows stay."""
    rows, at = numbered(docs)
    joined = _with_drops(rows, at["doc_id"], (index or LineIndex.of(docs)).drops())
    return in_batches(joined, _rewrite(rows.columns, at["text"], docs.columns), docs.schema)
