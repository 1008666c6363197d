"""Online sum-of-squares packing of token ids into fixed windows.

Each task packs the documents of its partition as they come, so no text or ids are shuffled. A level array holds the
number of partially filled windows at each fill level; a document goes into the level whose choice makes the sum of the
squared counts smallest, the fullest on ties. Whole windows of longer documents are cut off first. When MAX_OPEN windows
are open, which bounds a task's memory, and at the end, the fullest are topped up with pieces cut from the emptiest, which leaves one open window. At
the end that one is cut into sequences whose lengths are powers of two, which need no padding.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planloom.llm.common import in_batches

WINDOW = 4096
#: Closes every document.
END_ID = 2
#: Open windows of a task, by which its memory is bounded.
MAX_OPEN = 1024
#: Pieces of text whose ids a worker remembers.
MAX_CACHED = 300_000
#: Characters that are tokenized together.
GROUP_CHARS = 1 << 18

PIECES = "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"


#: Texts of these characters alone are split here; lower-casing and normalisation are plain for them.
PLAIN = bytes([9, 10, 13, *range(0x20, 0x7F), *(b for b in range(0xC0, 0x100) if b not in (0xD7, 0xF7))])
#: What the vocabulary's own pattern finds in such texts, once they are lower-cased.
PIECE = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|[^ \t\n\ra-zß-öø-ÿ0-9]+")


#: What a vocabulary file says if its texts can be cut into such pieces; texts of any other vocabulary are encoded whole.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


class PieceEncoder:
    """Ids of whole texts from the ids of their pieces, each distinct piece being tokenized once.

    The vocabulary's pattern cuts texts into runs of letters, digits and signs, and merges stay within them. Plain texts are
    cut by the same pattern here. Other texts are cut at blanks, tabs and line ends only, which neither the pattern nor the
    normaliser reaches across, and the tokenizer gets these chunks as they are.
    """

    def __init__(self, path: str, end_id: int = END_ID):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.end_id = Tokenizer.from_file(path), end_id
        said = json.loads(self.tokenizer.to_str())
        self.by_pieces = said["normalizer"] == NORMALIZER and said["pre_tokenizer"] == PRE_TOKENIZER and said["post_processor"] is None and not any(t["normalized"] or t["lstrip"] or t["rstrip"] for t in said["added_tokens"])
        self.model = self.tokenizer.model
        as_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = {c: as_bytes.pre_tokenize_str(chr(c))[0][0] for c in PLAIN if c > 32}
        self.known: dict[str, int] = {}
        self.starts, self.sizes = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)
        self.flat, self.used = np.zeros(1 << 14, np.uint32), 0

    def _learn(self, pieces: list[str]) -> None:
        chunks = [c[1:] for c in pieces if c[0] == "\0"]
        whole = dict(zip(chunks, self.tokenizer.encode_batch(chunks, add_special_tokens=False), strict=True))
        for c in pieces:
            ids, k = whole[c[1:]].ids if c[0] == "\0" else [t.id for t in self.model.tokenize(c.translate(self.letters))], len(self.known)
            if k == len(self.starts):
                self.starts, self.sizes = np.resize(self.starts, 2 * k), np.resize(self.sizes, 2 * k)
            while self.used + len(ids) > len(self.flat):
                self.flat = np.resize(self.flat, 2 * len(self.flat))
            self.flat[self.used : self.used + len(ids)] = ids
            self.known[c], self.starts[k], self.sizes[k] = k, self.used, len(ids)
            self.used += len(ids)

    def _forget(self) -> None:
        """Keeps the pieces learned first, which are the frequent ones."""
        self.known = dict(islice(self.known.items(), MAX_CACHED // 2))
        self.used = int(self.starts[len(self.known) - 1] + self.sizes[len(self.known) - 1])

    @staticmethod
    def split(text: str) -> list[str]:
        try:
            plain = not text.encode("latin-1").translate(None, PLAIN) and "<|" not in text
        except UnicodeEncodeError:
            plain = False
        if plain:
            return PIECE.findall(text.lower())
        return ["\0" + c for c in text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") if c]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, with the closing id."""
        if not self.by_pieces:
            return [np.array([*e.ids, self.end_id], np.uint32) for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
        if len(self.known) > MAX_CACHED:
            self._forget()
        pieces, ends = [], []
        for t in texts:
            pieces += self.split(t)
            ends.append(len(pieces))
        at = np.fromiter(map(self.known.get, pieces, repeat(-1)), np.int64, len(pieces))
        if len(new := np.flatnonzero(at < 0)):
            self._learn(sorted({pieces[i] for i in new}))
            at[new] = [self.known[pieces[i]] for i in new]
        sizes = self.sizes[at]
        past = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.flat[np.arange(past[-1]) + np.repeat(self.starts[at] - past[:-1], sizes)]
        cuts = past[np.array([0, *ends])]
        return [np.append(ids[a:b], np.uint32(self.end_id)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


_encoders: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """The worker's encoder, which goes on from task to task."""
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]


class SumOfSquares:
    """Packs items, which are (document, start, ids, document's tokens); ``emit`` gets each finished window's pieces."""

    def __init__(self, emit: Callable[[list[tuple]], None], size: int = WINDOW, max_open: int = MAX_OPEN):
        self.emit, self.size, self.max_open = emit, size, max_open
        self.level = np.zeros(size + 1, np.int64)
        self.windows: dict[int, list[list[tuple]]] = {}
        self.open = 0

    def add(self, doc, ids: np.ndarray) -> None:
        n = len(ids)
        whole = n - n % self.size
        for at in range(0, whole, self.size):
            self.emit([(doc, at, ids[at : at + self.size], n)])
        if whole < n:
            self._place((doc, whole, ids[whole:], n))
        if self.open > self.max_open:
            self.settle()

    def choose(self, s: int) -> int:
        """The level, 0 for a new window, that an item of ``s`` ids goes into."""
        base, after = self.level[: self.size - s + 1], self.level[s:]
        cost = 2 * (after - base + 1)  # the change of the sum when a window goes from one level to the other
        cost[-1] = 1 - 2 * base[-1]  # it is full then, and no longer counted
        cost[base == 0] = np.iinfo(np.int64).max
        cost[0] = 2 * after[0] + 1  # a new window
        return len(cost) - 1 - int(np.argmin(cost[::-1]))

    def _place(self, item: tuple) -> None:
        g = self.choose(len(item[2]))
        window = []
        if g:
            window = self.windows[g].pop()
            self.level[g] -= 1
            self.open -= 1
        self._keep([*window, item], g + len(item[2]))

    def _keep(self, window: list[tuple], level: int) -> None:
        if level == self.size:
            self.emit(window)
            return
        self.windows.setdefault(level, []).append(window)
        self.level[level] += 1
        self.open += 1

    def settle(self) -> None:
        """Tops up the fullest windows with pieces cut from the emptiest; one open window is left at most."""
        rest = [(g, w) for g in sorted(self.windows, reverse=True) for w in self.windows[g]]
        self.windows, self.open = {}, 0
        self.level[:] = 0
        low, high = 0, len(rest) - 1
        while low < high:
            g, window = rest[low]
            while g < self.size and low < high:
                h, donor = rest[high]
                doc, at, ids, n = donor.pop()
                take = min(len(ids), self.size - g)
                if take < len(ids):
                    donor.append((doc, at, ids[: len(ids) - take], n))
                    at, ids = at + len(ids) - take, ids[len(ids) - take :]
                window.append((doc, at, ids, n))
                g += take
                rest[high] = (h - take, donor)
                high -= h == take
            rest[low] = (g, window)
            if g == self.size:
                self.emit(window)
                low += 1
        if low <= high:
            self._keep(rest[low][1], rest[low][0])

    def finish(self) -> None:
        self.settle()
        for window in [w for ws in self.windows.values() for w in ws]:
            left = sum(len(x[2]) for x in window)
            while left:
                room, part = 1 << (left.bit_length() - 1), []
                left -= room
                while room:
                    doc, at, ids, n = window.pop(0)
                    if len(ids) > room:
                        window.insert(0, (doc, at + room, ids[room:], n))
                        ids = ids[:room]
                    part.append((doc, at, ids, n))
                    room -= len(ids)
                self.emit(part)
        self.windows, self.open = {}, 0


def _pack(path: str, size: int):
    names = [x.split()[0] for x in PIECES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence = TaskContext.get().partitionId() << 36
        rows = []

        def emit(window: list[tuple]) -> None:
            nonlocal sequence
            offset = 0
            for doc, at, ids, n in window:
                rows.append((doc, at, len(ids), ids.astype("<u4").tobytes(), n, sequence, offset))
                offset += len(ids)
            sequence += 1

        def flush() -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
            rows.clear()
            return out

        packer = SumOfSquares(emit, size)
        for batch in batches:
            texts, docs = batch.column("text"), batch.column("doc_id").to_pylist()
            at = 0
            while at < len(docs):
                group, chars = [], 0
                while at + len(group) < len(docs) and chars < GROUP_CHARS:
                    group.append(texts[at + len(group)].as_py() or "")
                    chars += len(group[-1])
                for doc, ids in zip(docs[at : at + len(group)], encoder(path).encode(group), strict=True):
                    packer.add(doc, ids)
                at += len(group)
                if len(rows) >= 1000:
                    yield flush()
        packer.finish()
        if rows:
            yield flush()

    return run


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW) -> DataFrame:
    """Pieces (doc_id, start, length, ids, doc_tokens, sequence_id, offset); ``ids`` are little-endian unsigned 32-bit.

    ``tokenizer`` is the path of a vocabulary file. A null or empty text has the closing id alone; a null doc_id stays null;
    repeated rows are packed each; an empty table gives no pieces; other columns are ignored. Sequences belong to one
    partition of the input, whose index is in the upper bits of sequence_id.
    """
    return in_batches(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), _pack(tokenizer, window), PIECES)


def piece_digests(pieces: DataFrame) -> DataFrame:
    """The pieces with the checksum of their ids in place of the ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
