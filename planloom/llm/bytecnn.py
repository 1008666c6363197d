"""Quality classifier: a byte-level convolutional network in numpy.

Bytes are embedded; learned filters of eight bytes, four apart, run over the whole text. Their outputs are max-pooled over
overlapping chunks of 512 bytes, 256 apart, a small layer gives each chunk a logit, and the mean of a text's logits,
shifted by the labels' odds, is its one probability. The network is trained on the driver with a bounded, balanced sample
of labelled rows, and is a few kilobytes when it is sent to the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planloom.llm.common import in_batches

#: Texts of each label in the training sample, and the bytes of one; of longer texts each such segment is a text.
SAMPLE_ROWS = 1024
SAMPLE_BYTES = 1 << 16
ACCEPT = 0.7
EPOCHS = 12
BATCH = 32
RATE = 0.01
SEED = 7
EMBED, FILTERS, HIDDEN = 8, 32, 16
#: Bytes of a stride; a filter sees two. Bytes from one chunk to the next; a chunk has two such halves.
STRIDE, HALF = 4, 256
#: Bytes that are convolved at a time.
SEGMENT = 1 << 18


@dataclass
class Network:
    """Weights by name; ``prior`` is the log odds of label 1 in all training labels, less that in the sample."""

    weights: dict[str, np.ndarray]
    prior: float = 0.0

    @classmethod
    def fresh(cls, seed: int = SEED) -> Network:
        rng = np.random.default_rng(seed)
        normal = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape).astype(np.float32)
        w = {"embed": rng.normal(0, 0.5, (256, EMBED)).astype(np.float32), "left": normal(STRIDE * EMBED, FILTERS), "right": normal(STRIDE * EMBED, FILTERS), "bias": np.zeros(FILTERS, np.float32)}
        w |= {"hidden": normal(FILTERS, HIDDEN), "hidden_bias": np.zeros(HIDDEN, np.float32), "out": normal(HIDDEN, 1)[:, 0], "out_bias": np.zeros(1, np.float32)}
        w["embed"][0] = 0  # padding
        return cls(w)

    def pooled(self, data: np.ndarray, last: np.ndarray, ahead: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Largest filter outputs of each half chunk, and where they are.

        data: blocks of STRIDE bytes; last: blocks that end a segment; ahead: the blocks that follow those.
        """
        w = self.weights
        x = w["embed"][data].reshape(len(data), -1)
        right = np.empty((len(data), FILTERS), np.float32)
        np.matmul(x[1:], w["right"], out=right[:-1])
        right[last] = w["embed"][ahead].reshape(len(ahead), -1) @ w["right"]
        right += x @ w["left"]
        halves = right.reshape(-1, HALF // STRIDE, FILTERS)
        at = halves.argmax(1)
        return np.take_along_axis(halves, at[:, None], 1)[:, 0], at

    def chunk_logits(self, maxima: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        w = self.weights
        features = np.maximum(maxima + w["bias"], 0)
        hidden = np.maximum(features @ w["hidden"] + w["hidden_bias"], 0)
        return hidden @ w["out"] + w["out_bias"], features, hidden

    def logits(self, texts: list[bytes]) -> np.ndarray:
        """The mean chunk logit of each whole text."""
        out, group, size = [], [], 0
        for text in texts:
            group.append(text)
            size += len(text)
            if size >= SEGMENT:
                out.append(self._logits(group))
                group, size = [], 0
        return np.concatenate([*out, self._logits(group) if group else np.empty(0, np.float32)])

    def _logits(self, texts: list[bytes]) -> np.ndarray:
        parts, owner = [], []
        held, blocks = [], 0
        for k, text in enumerate(texts):
            for at in range(0, max(len(text), 1), SEGMENT):
                held.append((text[at : at + SEGMENT], text[at + SEGMENT : at + SEGMENT + STRIDE]))
                owner.append(k)
                blocks += len(held[-1][0])
                if blocks >= SEGMENT:
                    parts.append((self.pooled(*lay(held))[0], [halves(len(a)) for a, _ in held]))
                    held, blocks = [], 0
        if held:
            parts.append((self.pooled(*lay(held))[0], [halves(len(a)) for a, _ in held]))
        maxima = np.concatenate([m for m, _ in parts])
        counts = np.bincount(np.array(owner), weights=np.array([n for _, ns in parts for n in ns]), minlength=len(texts)).astype(np.int64)
        chunked, sizes = overlap(maxima, counts)
        values, _, _ = self.chunk_logits(chunked)
        return np.add.reduceat(values, np.cumsum(sizes) - sizes) / sizes

    def scores(self, texts: list[bytes]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(texts).astype(np.float64) + self.prior, -50, 50)))


def halves(n: int) -> int:
    return max(1, -(-n // HALF))


def lay(segments: list[tuple[bytes, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Segments, each padded to whole half chunks, as blocks; the last block of each and the block after it."""
    data = b"".join(a.ljust(halves(len(a)) * HALF, b"\0") for a, _ in segments)
    last = np.cumsum([halves(len(a)) * HALF // STRIDE for a, _ in segments]) - 1
    return np.frombuffer(data, np.uint8).reshape(-1, STRIDE), last, np.frombuffer(b"".join(b.ljust(STRIDE, b"\0") for _, b in segments), np.uint8).reshape(-1, STRIDE)


def overlap(maxima: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chunks of two neighbouring halves, or of a text's only one; and the number of chunks of each text."""
    first = np.ones(len(maxima), bool)
    first[np.cumsum(counts) - 1] = counts == 1  # a last half begins no chunk unless it is alone
    at = np.flatnonzero(first)
    alone = np.repeat(counts == 1, counts)[at]
    return np.maximum(maxima[at], maxima[np.where(alone, at, np.minimum(at + 1, len(maxima) - 1))]), np.maximum(counts - 1, 1)


def train(texts: list[bytes], labels: np.ndarray, prior: float = 0.0, epochs: int = EPOCHS, seed: int = SEED) -> Network:
    """Adam on the mean chunk logit. The gradient reaches a filter only where its output was largest."""
    net, rng = Network.fresh(seed), np.random.default_rng(seed)
    m = {k: np.zeros_like(v) for k, v in net.weights.items()}
    v, step = {k: np.zeros_like(x) for k, x in net.weights.items()}, 0
    epochs = max(epochs, min(60, 20 * BATCH * epochs // max(len(texts), 1)))  # small samples are seen more often
    for epoch in range(epochs):
        order = rng.permutation(len(texts))
        for lo in range(0, len(order), BATCH):
            own = order[lo : lo + BATCH]
            grads = _gradients(net, [texts[i] for i in own], labels[own])
            step += 1
            for k, g in grads.items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                net.weights[k] -= (RATE * (1 - epoch / epochs) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
            net.weights["embed"][0] = 0
    net.prior = prior
    return net


def _gradients(net: Network, texts: list[bytes], labels: np.ndarray) -> dict[str, np.ndarray]:
    w = net.weights
    data, last, ahead = lay([(t, b"") for t in texts])
    counts = np.array([halves(len(t)) for t in texts])
    maxima, at = net.pooled(data, last, ahead)
    first = np.ones(len(maxima), bool)
    first[np.cumsum(counts) - 1] = counts == 1
    one = np.flatnonzero(first)
    two = np.where(np.repeat(counts == 1, counts)[one], one, np.minimum(one + 1, len(maxima) - 1))
    won = np.where(maxima[one] >= maxima[two], one[:, None], two[:, None])  # the half that gave each chunk's maximum
    chunked, sizes = overlap(maxima, counts)
    values, features, hidden = net.chunk_logits(chunked)
    logit = np.add.reduceat(values, np.cumsum(sizes) - sizes) / sizes
    slope = (1 / (1 + np.exp(-np.clip(logit, -50, 50))) - labels) / len(texts)
    g_out = np.repeat(slope / sizes, sizes).astype(np.float32)
    g_hidden = np.outer(g_out, w["out"]) * (hidden > 0)
    g_features = (g_hidden @ w["hidden"].T) * (features > 0)
    grads = {"out": hidden.T @ g_out, "out_bias": g_out.sum(keepdims=True), "hidden": features.T @ g_hidden, "hidden_bias": g_hidden.sum(0), "bias": g_features.sum(0)}
    filters = np.broadcast_to(np.arange(FILTERS), won.shape)
    place = won * (HALF // STRIDE) + at[won, filters]
    g_embed, pad = np.zeros_like(w["embed"]), np.zeros((1, STRIDE), np.uint8)
    after = np.concatenate([data[1:], pad])
    after[last] = ahead
    for name, blocks in (("left", data), ("right", after)):
        own = blocks[place]  # chunk, filter, byte
        grads[name] = np.einsum("cf,cfd->df", g_features, w["embed"][own].reshape(*place.shape, -1))
        down = g_features[:, :, None] * w[name].T[None]
        np.add.at(g_embed, own.ravel(), down.reshape(-1, EMBED))
    grads["embed"] = g_embed
    return grads


def held_out(doc_id):
    """Rows that no label is ever learned from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, longest: int = SAMPLE_BYTES) -> Network | None:
    """A network trained on at most ``rows`` texts of each label, or nothing if a label has none.

    The sample are the texts with the smallest hashes of doc_id. A text of more than ``longest`` bytes counts as its segments
    of so many, each by a hash of its own. Of a doc_id with several labels the smallest counts, and of repeated documents the
    smallest text.
    """
    usable = labels.where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.min("quality").cast("int").alias("quality"))
    total = {r["quality"]: r["count"] for r in usable.groupBy("quality").count().collect()}
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    sizes = texts.select("doc_id", F.octet_length("text").alias("size")).groupBy("doc_id").agg(F.max("size").alias("size"))
    segments = usable.join(sizes, "doc_id").withColumn("segment", F.explode(F.expr(f"sequence(0, greatest(size - 1, 0) div {longest})")))
    order = F.when(F.col("segment") == 0, F.xxhash64("doc_id")).otherwise(F.xxhash64("doc_id", "segment"))
    parts = [segments.where(F.col("quality") == q).orderBy(order, "doc_id", "segment").limit(rows) for q in (0, 1)]
    chosen = F.broadcast(parts[0].unionByName(parts[1]).select("doc_id", "quality", "segment"))  # twice ``rows`` at most
    own = F.expr(f"substring(text, cast(segment * {longest} + 1 as int), {longest})")
    sample = texts.join(chosen, "doc_id").select("doc_id", "quality", "segment", own.alias("text")).groupBy("doc_id", "quality", "segment").agg(F.min("text").alias("text"))
    found = sorted(sample.collect(), key=lambda r: (r["doc_id"], r["segment"]))
    y = np.array([r["quality"] for r in found], np.float32)
    if not (y == 0).any() or not (y == 1).any():
        return None
    prior = np.log(total[1] / total[0]) - np.log((y == 1).sum() / (y == 0).sum())
    return train([bytes(r["text"]) for r in found], y, float(prior))


def _score(net: Network | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.as_py() or b"" for t in batch.column("text").cast(pa.binary())]
            scores = net.scores(texts) if net and texts else np.full(len(texts), 0.5)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(scores, pa.float64())], ["doc_id", "held_out", "score"])

    return run


def _accept(net: Network | None, accept: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
            good = net.scores(texts) >= accept if net and texts else np.ones(len(texts), bool)
            yield batch.filter(pa.array(good))

    return run


def score_quality(docs: DataFrame, labels: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """doc_id, held_out, score, predicted of every row, from its whole text alone.

    A null text is an empty one, which is scored as a chunk of padding. A null doc_id is not held out. Repeated rows are
    scored each. If a label is missing, all scores are 0.5. An empty table gives no rows; other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    scored = in_batches(rows, _score(fit(docs, labels)), "doc_id bigint, held_out boolean, score double")
    return scored.withColumn("predicted", F.when(F.col("score") >= accept, 1).otherwise(0))


def keep_accepted(docs: DataFrame, labels: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """``docs`` without the rows that score below ``accept``; without labels of both kinds all stay."""
    return in_batches(docs, _accept(fit(docs, labels), accept), docs.schema)
