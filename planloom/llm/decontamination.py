"""Benchmark decontamination by suffix arrays of the training text.

Every shard (a run of documents) is turned into one array of word numbers, and all its suffixes into a suffix array, sorted
by their first words. Every test suffix is then found by binary search; the intervals that a test suffix falls in are
sorted by the whole window, and searched again. Equal neighbours give all places of a window, and places in a row along a
diagonal give the longest verbatim matches with their locations. Words are numbered by the test's own vocabulary, exactly.
The test set reaches the tasks in blocks of a fixed number of words, one at a time; training text is never shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planloom.llm.common import in_batches

#: Words of a window.
WINDOW = 13
#: Words by which all suffixes are sorted first; fewer if their numbers would not fit 63 bits.
LEAD = 3
#: Words of the test set that a task holds at a time.
BLOCK_WORDS = 1 << 20
#: Bytes of training text in one suffix array, within an Arrow batch; a longer document has an array of its own.
SHARD_BYTES = 1 << 22
#: Digits, A-Z as a-z, a-z and all non-ASCII bytes are words; every other byte separates.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


class TestBlock:
    """Some items of the test set: their windows, sorted for binary search."""

    __test__ = False

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window, self.names = window, sorted({name for name, _ in items})
        self.vocabulary: dict[bytes, int] = {}
        number, seen = {n: k for k, n in enumerate(self.names)}, {}
        for name, ws in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in ws]
            width = min(window, len(ids))
            for at in range(len(ids) - width + 1 if width else 0):
                seen.setdefault(tuple(ids[at : at + width]), []).append((number[name], at))
        self.windows = sorted(seen)
        self.owners = [seen[w] for w in self.windows]
        self.widths = np.array([len(w) for w in self.windows], np.int64)
        padded = np.zeros((2, len(self.windows), window), ">u4")
        padded[1] = 0xFFFFFFFF
        for k, w in enumerate(self.windows):
            padded[:, k, : len(w)] = np.array(w) + 1
        self.low, self.high = (_keys(x) for x in padded)
        self.base = len(self.vocabulary) + 1
        self.lead = min(LEAD, 63 // self.base.bit_length())
        # the first and last number of the suffixes that begin as a window does
        self.leads = np.array(sorted({_interval(w[: self.lead], self.base, self.lead) for w in self.windows}), np.int64).reshape(-1, 2)

    def suffixes(self, ids: np.ndarray) -> np.ndarray:
        """Places of the suffix array's intervals that test suffixes fall in; ``ids`` are the word numbers from 1, and 0 for all other words and for ends."""
        value = np.zeros(len(ids), np.int64)
        for n in range(self.lead):
            value *= self.base
            value[: len(ids) - n] += ids[n:]
        array = np.argsort(value, kind="stable")
        value = value[array]
        first, last = np.searchsorted(value, self.leads[:, 0], "left"), np.searchsorted(value, self.leads[:, 1], "right")
        edge = np.bincount(first, minlength=len(ids) + 1) - np.bincount(last, minlength=len(ids) + 1)  # a shorter window's interval may hold others
        return array[np.cumsum(edge[:-1]) > 0]

    def search(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, place) of all places of all windows."""
        places = self.suffixes(ids)
        if not len(places) or not len(self.windows):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        padded = np.concatenate([ids, np.zeros(self.window, ids.dtype)])
        keys = _keys(padded[places[:, None] + np.arange(self.window)].astype(">u4"))
        array = np.argsort(keys, kind="stable")
        first = np.searchsorted(keys, self.low, "left", sorter=array)
        counts = np.searchsorted(keys, self.high, "right", sorter=array) - first
        # a full window has the same lower and upper key, so only equal suffixes lie between
        full = self.widths == self.window
        counts[full] = np.searchsorted(keys, self.low[full], "right", sorter=array) - first[full]
        which = np.repeat(np.arange(len(counts)), counts)
        nth = np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts)
        return which, places[array[first[which] + nth]]


def _keys(rows: np.ndarray) -> np.ndarray:
    """Rows of big-endian numbers as byte strings, which sort as the rows do."""
    return np.ascontiguousarray(rows).view(f"S{rows.shape[1] * 4}")[:, 0]


def _interval(ids: tuple[int, ...], base: int, lead: int) -> tuple[int, int]:
    value = 0
    for i in ids:
        value = value * base + i + 1
    rest = base ** (lead - len(ids))
    return value * rest, value * rest + rest - 1


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    for batch in batches:
        texts, at = batch.column("text").cast(pa.binary()), 0
        while at < len(texts):
            found, size = [], 0
            while at + len(found) < len(texts) and size < SHARD_BYTES:
                found.append(texts[at + len(found)].as_py() or b"")
                size += len(found[-1])
            yield batch.slice(at, len(found)), found
            at += len(found)


def _judge(texts: list[bytes], blocks) -> Iterator[tuple[np.ndarray, list[set], list[list]]]:
    """For a shard: words hit in each document, its items, and its longest matches (item, item's word, word, words)."""
    found = [words(t) for t in texts] if len(blocks) == 1 else None
    sizes = np.array([len(f) for f in found] if found else [len(words(t)) for t in texts], np.int64)
    starts = np.cumsum(sizes + 1) - sizes - 1
    edge, items, longest = np.zeros(int((sizes + 1).sum()) + 1, np.int32), [set() for _ in texts], [[] for _ in texts]
    for shared in blocks:
        block = shared.value
        if len(blocks) > 1:  # one block at a time: the broadcast's copy in this worker is read again when needed
            vars(shared).pop("_value", None)
        ids = np.zeros(len(edge) - 1, np.int64)
        get = block.vocabulary.get
        for k, (s, n) in enumerate(zip(starts, sizes, strict=True)):
            ids[s : s + n] = np.fromiter(map(get, found[k] if found else words(texts[k]), repeat(-1)), np.int64, n) + 1
        which, at = block.search(ids)
        np.add.at(edge, at, 1)
        np.add.at(edge, at + block.widths[which], -1)
        docs = np.searchsorted(starts, at, "right") - 1
        runs = sorted({(int(d), item, int(p) - start, start, int(w)) for d, p, w in zip(docs, at - starts[docs], which, strict=True) for item, start in block.owners[w]})
        last = None
        for d, item, diagonal, start, w in runs:
            items[d].add(block.names[item])
            width = len(block.windows[w])
            if last and last[:3] == (d, item, diagonal) and last[3] + 1 == start:
                longest[d][-1][3] += 1
            else:
                longest[d].append([block.names[item], start, diagonal + start, width])
            last = (d, item, diagonal, start)
    hit = np.concatenate([[0], np.cumsum(np.cumsum(edge[:-1]) > 0)])
    return sizes, hit[starts + sizes] - hit[starts], items, longest


MATCHES = "array<struct<item_id: string, item_start: bigint, doc_start: bigint, words: bigint>>"


def _find(blocks, fields: list[str], keep_clean: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("item_id", pa.string()), ("item_start", pa.int64()), ("doc_start", pa.int64()), ("words", pa.int64())]))
        for rows, texts in _shards(batches):
            sizes, hits, items, longest = _judge(texts, blocks)
            bad = (hits > 0) & (20 * hits >= sizes)
            columns = [rows.column(f) for f in fields]
            if keep_clean:
                yield pa.RecordBatch.from_arrays([c.filter(pa.array(~bad)) for c in columns], fields)
                continue
            digest = [hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() for x in items]
            matches = pa.array([[dict(zip(("item_id", "item_start", "doc_start", "words"), m, strict=True)) for m in x] for x in longest], kind)
            more = [pa.array(sizes), pa.array(hits.astype(np.int64)), pa.array([len(x) for x in items], pa.int64()), pa.array(digest, pa.string()), pa.array(bad), matches]
            yield pa.RecordBatch.from_arrays([*columns, *more], [*fields, "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "matches"])

    return run


def test_blocks(benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> list:
    """The test set as broadcasts of at most ``block_words`` words each, or of one longer item."""
    sc, out, held, size = benchmark.sparkSession.sparkContext, [], [], 0
    for row in benchmark.select("item_id", "text").toLocalIterator():
        ws = words((row["text"] or "").encode())
        if held and size + len(ws) > block_words:
            out.append(sc.broadcast(TestBlock(held, window)))
            held, size = [], 0
        if ws:
            held.append(("null" if row["item_id"] is None else str(row["item_id"]), ws))
            size += len(ws)
    return [*out, sc.broadcast(TestBlock(held, window))] if held else out


test_blocks.__test__ = False


def find_matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated and the longest verbatim matches of every row.

    A null text or item has no words; an item without words matches nothing; a null item_id is named ``null``; items with
    the same id count as one; repeated documents are judged each; with an empty test set nothing is hit; other columns are
    ignored.
    """
    schema = f"doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean, matches {MATCHES}"
    return in_batches(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), _find(test_blocks(benchmark), ["doc_id"], False), schema)


def remove_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the contaminated rows, all columns as they are."""
    return in_batches(docs, _find(test_blocks(benchmark), docs.columns, True), docs.schema)
