"""Text features on tables (row_id, token counts) in DataFrame operations, and a string encoder with bounded state."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from planloom.operators.base import training
from planloom.plans.runtime import FOLD, Frame, fresh

#: Buckets of hashed tokens: a state over all buckets is 8 MB, whatever the input.
BUCKETS = 1 << 20
#: Buckets where a matrix of buckets x components is kept: 24 MB for 30 components.
SVD_BUCKETS = 1 << 16
OVERSAMPLE = 16


def clean(c: Column) -> Column:
    """Text of any value; null and NaN are empty."""
    text = c.cast("string")
    nan = F.typeof(c).isin("float", "double") & (text == "NaN")
    return F.when(text.isNull() | nan, F.lit("")).otherwise(text)


def _padded(text: Column, analyzer: str) -> Column:
    if analyzer not in ("char", "char_wb"):
        raise ValueError(f"analyzer must be 'char' or 'char_wb', got {analyzer!r}")
    text = clean(text)
    return F.concat(F.lit(" "), text, F.lit(" ")) if analyzer == "char_wb" else text


def _grams(text: Column, n: int) -> Column:
    many = F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - (n - 1), F.lit(1))), lambda i: F.substring(text, i, F.lit(n)))
    return F.when(F.length(text) >= n, many).otherwise(F.array().cast("array<string>"))


def ngrams(c: Column, analyzer: str = "char", low: int = 3, high: int = 4) -> Column:
    """All substrings of ``low`` to ``high`` characters; ``char_wb`` pads the whole text with a blank at both ends."""
    text = _padded(c, analyzer)
    return F.concat(*[_grams(text, n) for n in range(max(low, 1), high + 1)])


def _characters(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(row, character) of all texts on end, in time linear in their bytes; characters are places in the third, which has each once."""
    data = np.frombuffer(b"".join(texts.cast(pa.binary()).to_pylist()), np.uint8)
    at = np.flatnonzero((data & 0xC0) != 0x80)
    sizes = np.diff(at, append=len(data))
    packed = np.zeros(len(at), np.uint32)
    for j in range(4):
        more = sizes > j
        packed[more] |= data[at[more] + j].astype(np.uint32) << np.uint32(8 * j)
    found, first, codes = np.unique(packed, return_index=True, return_inverse=True)
    letters = pa.array([data[at[i] : at[i] + sizes[i]].tobytes() for i in first], pa.binary()).cast(pa.string())
    starts = np.concatenate([[0], np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))])
    return np.searchsorted(starts, at, side="right") - 1, codes.astype(np.int64), letters


def _places(groups: np.ndarray, codes: np.ndarray, letters: pa.Array, rows: np.ndarray, n: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(group, token) of the n-grams that start from ``low`` up to ``high``; tokens are places in the third, which has each once."""
    at = np.arange(low, min(high, len(codes) - n + 1))
    at = at[rows[at] == rows[at + n - 1]]
    keys, bound = codes[at], len(letters)
    for j in range(1, n):
        if bound * len(letters) >= 1 << 62:
            found, keys = np.unique(keys, return_inverse=True)
            bound = len(found)
        keys, bound = keys * len(letters) + codes[at + j], bound * len(letters)
    _, first, places = np.unique(keys, return_index=True, return_inverse=True)
    parts = [letters.take(pa.array(codes[at[first] + j])) for j in range(n)]
    return groups[at], places, pc.binary_join_element_wise(*parts, "")


#: What a worker hashed last: n-grams come again and again.
_HASHES: dict[str, int] = {}


def _hashes(tokens: pa.Array, buckets: int) -> np.ndarray:
    """``hash_bucket`` in a worker."""
    if len(_HASHES) > 1 << 19:
        _HASHES.clear()
    out = np.empty(len(tokens), np.int64)
    for i, t in enumerate(tokens.to_pylist()):
        h = _HASHES.get(t)
        if h is None:
            h = _HASHES[t] = int.from_bytes(hashlib.md5(t.encode()).digest()[:4], "big")
        out[i] = h
    return out % buckets


#: Characters in a partition of texts, such partitions at most, and n-grams counted at once.
PART_CHARACTERS, PARTS, AT_ONCE = 1 << 20, 4096, 1 << 19


def extent(df: DataFrame, text: str, analyzer: str = "char_wb") -> tuple[int, int]:
    """(rows, partitions for them): as many as the texts' length asks for, however few files there are."""
    rows, length = df.agg(F.count("*"), F.sum(F.length(_padded(F.col(text), analyzer)))).first()
    return rows, min(max((length or 0) // PART_CHARACTERS, df.sparkSession.sparkContext.defaultParallelism), PARTS)


def token_counts(df: DataFrame, row_id: str, text: str, analyzer: str = "char_wb", low: int = 3, high: int = 4, buckets: int | None = None, parts: int | None = None) -> DataFrame:
    """(row_id, token, tf); with ``buckets`` tokens are ``hash_bucket``s.

    Texts are dealt out by row_id and come to a worker in its order, which counts a row_id's n-grams and is done with them:
    n-grams are neither shuffled nor kept. There are ``parts`` partitions, else those of ``extent``.
    """
    parts = parts or extent(df, text, analyzer)[1]
    df = df.select(F.col(row_id).alias("row_id"), _padded(F.col(text), analyzer).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, open_ = None, {}  # the row_id that may go on, and its counts

        def made(ids: pa.Array, tokens: pa.Array, tf) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([ids, tokens, pa.array(tf, pa.int64())], ["row_id", "token", "tf"])

        def closed() -> Iterator[pa.RecordBatch]:
            if open_:
                yield made(pa.repeat(last[0], len(open_)), pa.array(open_.keys(), kind), open_.values())
                open_.clear()

        kind = pa.string() if buckets is None else pa.int64()
        for b in batches:
            if not b.num_rows:
                continue
            ids, texts = b.column("row_id"), b.column("text")
            marks = ids.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            new = np.r_[True, marks[1:] != marks[:-1]]
            of_row = np.cumsum(new) - 1
            heads = ids.take(pa.array(np.flatnonzero(new)))
            rows, codes, letters = _characters(texts)
            groups = of_row[rows]
            if last is None or not last.equals(heads.slice(0, 1)):
                yield from closed()
            ahead = 0  # the group that is open
            for at in range(0, len(codes), AT_ONCE):
                end = min(at + AT_ONCE, len(codes))
                final = groups[end - 1]
                found = [_places(groups, codes, letters, rows, n, at, end) for n in range(max(low, 1), high + 1)]
                if buckets is not None:  # n-grams of any length share buckets
                    hashed, places = np.unique(np.concatenate([_hashes(t, buckets)[p] for _, p, t in found]), return_inverse=True)
                    found = [(np.concatenate([g for g, _, _ in found]), places, pa.array(hashed))]
                whole = []
                for g, places, tokens in found:
                    if not len(g):
                        continue
                    cells, tf = np.unique(g * len(tokens) + places, return_counts=True)
                    g, places = np.divmod(cells, len(tokens))
                    whole.append((g, tokens.take(pa.array(places)), tf))
                for edge in dict.fromkeys((ahead, final)):
                    if edge != ahead:
                        last = heads.slice(ahead, 1)
                        yield from closed()
                    for g, tokens, tf in whole:
                        of = np.flatnonzero(g == edge)
                        for t, k in zip(tokens.take(pa.array(of)).to_pylist(), tf[of].tolist(), strict=True):
                            open_[t] = open_.get(t, 0) + k
                for g, tokens, tf in whole:
                    of = np.flatnonzero((g != ahead) & (g != final))
                    if len(of):
                        yield made(heads.take(pa.array(g[of])), tokens.take(pa.array(of)), tf[of])
                ahead = final
            if ahead != len(heads) - 1:  # the last texts have no characters
                last = heads.slice(ahead, 1)
                yield from closed()
            last = heads.slice(len(heads) - 1, 1)
        yield from closed()

    schema = T.StructType([T.StructField("row_id", df.schema["row_id"].dataType), T.StructField("token", T.StringType() if buckets is None else T.LongType()), T.StructField("tf", T.LongType())])
    return df.repartition(parts, "row_id").sortWithinPartitions("row_id").mapInArrow(run, schema)


def hash_bucket(token: Column, buckets: int = BUCKETS) -> Column:
    """The first 32 bits of the token's MD5, modulo the buckets."""
    return F.pmod(F.conv(F.substring(F.md5(token.cast("binary")), 1, 8), 16, 10).cast("bigint"), F.lit(buckets))


def inverse_frequency(counts: DataFrame, rows: int) -> DataFrame:
    """(token, df, idf): ln((1 + rows) / (1 + df)) + 1."""
    return counts.groupBy("token").agg(F.count("*").alias("df")).withColumn("idf", F.ln((1 + F.lit(rows)) / (1 + F.col("df"))) + 1)


def tfidf(counts: DataFrame, idf: DataFrame, parts: int | None = None) -> DataFrame:
    """(row_id, token, value) with rows of length one; tokens without an idf are left out. ``parts`` is the number of partitions."""
    weighed = counts.join(idf.select("token", "idf"), "token").select("row_id", "token", (F.col("tf") * F.col("idf")).alias("v"))
    weighed = weighed.repartition(parts, "row_id") if parts else weighed
    norm = F.sqrt(F.sum(F.col("v") * F.col("v")).over(Window.partitionBy("row_id")))  # joined to the rows, all norms might be sent to the driver and out
    return weighed.select("row_id", "token", (F.col("v") / norm).alias("value"))


def project(weights: DataFrame, width: int, seed: int = 42) -> DataFrame:
    """(row_id, values): ``width`` sums by random signs, the last bits of the MD5 of seed and token; no matrix of signs is made."""
    if not 0 < width <= 64:
        raise ValueError("a hash has 64 signs")
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("token")).cast("binary")), 17, 16)
    signed = weights.select("row_id", "value", F.conv(digits, 16, -10).cast("bigint").alias("bits"))
    sums = [F.sum(F.when(F.getbit("bits", F.lit(t)) == 1, -F.col("value")).otherwise(F.col("value"))) for t in range(width)]
    return signed.groupBy("row_id").agg(F.array(*sums).alias("values"))


def gram(rows: DataFrame, values: str, width: int) -> DataFrame:
    """(i, j, gram): the sum of the rows' outer products, added up in each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for b in batches:
            y = b.column(0).flatten().to_numpy().reshape(-1, width)
            total += y.T @ y
        at = np.arange(width * width, dtype=np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(at // width), pa.array(at % width), pa.array(total.ravel())], ["i", "j", "gram"])

    return rows.select(values).mapInArrow(run, "i int, j int, gram double").groupBy("i", "j").agg(F.sum("gram").alias("gram"))


def _bucket_lists(texts: pa.Array, low: int, high: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(flat, sizes): the buckets of all n-grams of padded texts, in a worker."""
    rows, codes, letters = _characters(texts)
    found = [_places(rows, codes, letters, rows, n, at, at + AT_ONCE) for n in range(max(low, 1), high + 1) for at in range(0, len(codes), AT_ONCE)]
    of = np.concatenate([g for g, _, _ in found] or [np.zeros(0, np.int64)])
    flat = np.concatenate([_hashes(t, buckets)[p] for _, p, t in found] or [np.zeros(0, np.int64)])
    return flat[np.argsort(of, kind="stable")], np.bincount(of, minlength=len(texts))


def weighed_lists(df: DataFrame, fold: Column, c: Column, analyzer: str, low: int, high: int, buckets: int) -> DataFrame:
    """(k, w, t): the fold, number and buckets of each different text."""

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def lists(texts: pa.Array) -> pa.Array:
        flat, sizes = _bucket_lists(texts, low, high, buckets)
        return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), pa.array(flat, pa.int32()))

    texts = df.select(fold.cast("int").alias("k"), _padded(c, analyzer).alias("s")).groupBy("k", "s").agg(F.count("*").alias("w"))
    return texts.select("k", "w", lists("s").alias("t"))


def _vectors(flat: np.ndarray, sizes: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, value) of normalised rows; ``flat`` has the buckets of all rows, ``sizes`` of them in each."""
    cells, tf = np.unique(np.repeat(np.arange(len(sizes)), sizes) * len(idf) + flat, return_counts=True)
    rows, buckets = np.divmod(cells, len(idf))
    values = tf * idf[buckets]
    norm = np.sqrt(np.bincount(rows, weights=values * values, minlength=len(sizes)))
    return rows, buckets, values / norm[rows]


def _lists(column: pa.Array, at: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(flat, sizes) of some rows of a list column."""
    column = column if at is None else column.take(pa.array(at))
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)


@lru_cache(maxsize=2)
def _signs(seed: int, buckets: int) -> np.ndarray:
    """64 random bits for each bucket, drawn once in a worker."""
    return np.random.default_rng(seed).integers(0, 1 << 64, buckets, dtype=np.uint64)


def _sketch(vectors, n: int, signs: np.ndarray, width: int) -> np.ndarray:
    rows, buckets, values = vectors
    out = np.zeros((n, width))
    bits = signs[buckets]
    for t in range(width):
        sign = 1.0 - 2.0 * ((bits >> np.uint64(t)) & np.uint64(1)).astype(np.float64)
        out[:, t] = np.bincount(rows, weights=values * sign, minlength=n)
    return out


def top_directions(gram: np.ndarray, k: int) -> np.ndarray:
    """The k eigenvectors of the largest eigenvalues; the entry of largest size is positive in each; zero beyond the rank."""
    values, vectors = np.linalg.eigh(gram)
    order = np.argsort(values)[::-1][:k]
    out = vectors[:, order] * (values[order] > max(values.max(initial=0), 0) * 1e-12)
    sign = np.sign(out[np.abs(out).argmax(0), np.arange(out.shape[1])])
    out = out * np.where(sign == 0, 1, sign)
    return np.pad(out, ((0, 0), (0, k - out.shape[1])))


@dataclass(frozen=True)
class StringEncoder:
    """Text to ``components`` numbers: hashed n-gram TF-IDF, and its principal directions.

    With ``reduction`` ``sketch`` these are of a sketch by random signs; with ``svd`` of the TF-IDF itself, whose right singular
    vectors are found by power iteration. The state of a fold is an idf for each bucket and one matrix, so it is broadcast
    within a known bound, and encoding is local to each row. Outputs are divided by the root of their total variance in the
    training rows (1 if that is 0).
    """

    components: int = 30
    analyzer: str = "char_wb"
    low: int = 3
    high: int = 4
    buckets: int | None = None
    seed: int = 42
    reduction: str = "sketch"

    def __post_init__(self):
        if self.components < 1 or self.components + OVERSAMPLE > 64:
            raise ValueError(f"components must be 1 to {64 - OVERSAMPLE}")
        if self.analyzer not in ("char", "char_wb"):
            raise ValueError(f"analyzer must be 'char' or 'char_wb', got {self.analyzer!r}")
        if self.reduction not in ("sketch", "svd"):
            raise ValueError(f"reduction must be 'sketch' or 'svd', got {self.reduction!r}")

    @property
    def width(self) -> int:
        return self.components + OVERSAMPLE

    @property
    def size(self) -> int:
        return self.buckets or (BUCKETS if self.reduction == "sketch" else SVD_BUCKETS)

    def _embedded(self, vectors, n: int, matrix: np.ndarray) -> np.ndarray:
        if self.reduction == "svd":
            return _times(vectors, n, matrix)
        return _sketch(vectors, n, _signs(self.seed, self.size), self.width) @ matrix

    def fit(self, x, y=None):
        df, keys = training(x.rows)
        sc, state, fold = df.sparkSession.sparkContext, [], F.col(FOLD) if keys else F.lit(0)
        for c in x.cols.values():
            lists = weighed_lists(df, fold, c, self.analyzer, self.low, self.high, self.size).persist()
            try:
                found = idf_of(lists, self.size)
                if self.reduction == "svd":
                    matrices = {k: right_vectors(lists.where(F.col("k") == k), found[k], self.components, seed=self.seed)[1] for k in found}
                else:
                    matrices = dict.fromkeys(found, np.eye(self.width))
                idf, fitted = sc.broadcast(found), {}
                for k, (n, total, products) in self._moments(lists, idf, sc.broadcast(matrices)).items():
                    mean = total / n
                    p = top_directions(products, self.components) if self.reduction == "sketch" else np.eye(self.components)
                    variance = np.trace(p.T @ (products / n - np.outer(mean, mean)) @ p)
                    fitted[k] = matrices[k] @ p / (np.sqrt(variance) if variance > 1e-18 else 1.0)
                state.append((idf, sc.broadcast(fitted)))
            finally:
                lists.unpersist()
        return state

    def _moments(self, lists: DataFrame, idf, matrices) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
        """(rows, sum, sum of outer products) of the embedded rows of each fold."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = {}
            for b in batches:
                folds, weights = b.column("k").to_numpy(), b.column("w").to_numpy()
                for k in map(int, np.unique(folds)):
                    at = np.flatnonzero(folds == k)
                    flat, sizes = _lists(b.column("t"), at)
                    y, w = self._embedded(_vectors(flat, sizes, idf.value[k]), len(sizes), matrices.value[k]), weights[at]
                    total[k] = total.get(k, 0) + np.concatenate([((y * w[:, None]).T @ y).ravel(), w @ y, [w.sum()]])
            for k, v in total.items():
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), k, np.int32)), pa.array(np.arange(len(v), dtype=np.int32)), pa.array(v)], ["k", "i", "v"])

        sums: dict[int, dict[int, float]] = {}
        for r in lists.mapInArrow(run, "k int, i int, v double").groupBy("k", "i").agg(F.sum("v").alias("v")).collect():  # width squared, for each fold
            sums.setdefault(r["k"], {})[r["i"]] = r["v"]
        out = {}
        for k, s in sums.items():
            v = np.array([s[i] for i in range(len(s))])
            w = int((np.sqrt(4 * len(v) - 3) - 1) / 2)
            out[k] = (v[-1], v[w * w : -1], v[: w * w].reshape(w, w))
        return out

    def _encoder(self, idf, fitted):
        @F.arrow_udf("array<double>")
        def encode(texts: pa.Array, fold: pa.Array) -> pa.Array:
            folds, out = fold.to_numpy(zero_copy_only=False), np.zeros((len(texts), self.components))
            for k in map(int, np.unique(folds)):
                if k in fitted.value:  # else there are no training rows
                    at = np.flatnonzero(folds == k)
                    each = texts.take(pa.array(at)).dictionary_encode()  # equal texts have equal vectors
                    vectors = _vectors(*_bucket_lists(each.dictionary, self.low, self.high, self.size), idf.value[k])
                    out[at] = self._embedded(vectors, len(each.dictionary), fitted.value[k])[each.indices.to_numpy()]
            return pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1, dtype=np.int32) * self.components), pa.array(out.ravel()))

        return encode

    def transform(self, state, x):
        rows, out, fold = x.rows, {}, F.col(FOLD) if x.rows.split else F.lit(0)
        for (n, c), (idf, fitted) in zip(x.cols.items(), state, strict=True):
            name, encoded = fresh("e"), self._encoder(idf, fitted)(_padded(c, self.analyzer), fold)
            rows = rows.extended(lambda df, name=name, encoded=encoded: df.withColumn(name, encoded))
            out |= {f"{n}_{i}": F.element_at(F.col(name), i + 1) for i in range(self.components)}
        return Frame(rows, out)


def idf_of(lists: DataFrame, buckets: int) -> dict[int, np.ndarray]:
    """The idf of each bucket for each fold k; lists: (k, w, t)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, np.ndarray] = {}
        for b in batches:
            folds, weights = b.column("k").to_numpy(), b.column("w").to_numpy()
            for k in map(int, np.unique(folds)):
                at = np.flatnonzero(folds == k)
                flat, sizes = _lists(b.column("t"), at)
                rows, found = np.divmod(np.unique(np.repeat(np.arange(len(at)), sizes) * buckets + flat), buckets)
                counts = seen.setdefault(k, np.zeros(buckets + 1, np.int64))
                np.add.at(counts, found, weights[at][rows])
                counts[buckets] += weights[at].sum()  # rows come last
        for k, counts in seen.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k, np.int32)), pa.array(at), pa.array(counts[at])], ["k", "b", "n"])

    counted = lists.mapInArrow(run, "k int, b long, n long").groupBy("k", "b").agg(F.sum("n").alias("n")).toArrow()  # at most a row for each bucket and fold
    folds, at, counts = (counted.column(c).to_numpy() for c in ("k", "b", "n"))
    out = {}
    for k in map(int, np.unique(folds)):
        own = np.zeros(buckets + 1, np.int64)
        own[at[folds == k]] = counts[folds == k]
        out[k] = np.log((1 + own[buckets]) / (1 + own[:buckets])) + 1
    return out


def _times(vectors, n: int, matrix: np.ndarray) -> np.ndarray:
    """The product of sparse rows and a matrix."""
    rows, buckets, values = vectors
    out = np.zeros((n, matrix.shape[1]))
    if len(rows):
        first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
        out[rows[first]] = np.add.reduceat(values[:, None] * matrix[buckets], first)
    return out


def right_vectors(texts: DataFrame, idf: np.ndarray, k: int, rounds: int = 5, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """(singular values, right vectors) of the TF-IDF rows of weighed bucket lists, by randomised power iteration.

    Lists should be persisted. Every round is one pass whose partial products, features x (k + 16), are summed in Spark;
    only that matrix reaches the driver.
    """
    features, sc = len(idf), texts.sparkSession.sparkContext
    if not 0 < k <= features:
        raise ValueError(f"k must be 1 to {features}")
    width, weights = min(k + OVERSAMPLE, features), sc.broadcast(idf)

    def times(q: np.ndarray) -> np.ndarray:
        shared = sc.broadcast(q)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(q.shape)
            for b in batches:
                rows, buckets, values = _vectors(*_lists(b.column("t")), weights.value)
                part = (values * b.column("w").to_numpy()[rows])[:, None] * _times((rows, buckets, values), b.num_rows, shared.value)[rows]
                order = np.argsort(buckets, kind="stable")
                if len(order):
                    sorted_ = buckets[order]
                    first = np.flatnonzero(np.r_[True, sorted_[1:] != sorted_[:-1]])
                    total[sorted_[first]] += np.add.reduceat(part[order], first)
            at = np.flatnonzero(total.any(1))
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *(pa.array(total[at, j]) for j in range(total.shape[1]))], ["i", *names])

        names = [f"v{j}" for j in range(q.shape[1])]
        made = texts.mapInArrow(run, "i int, " + ", ".join(f"{v} double" for v in names))
        summed = made.groupBy("i").agg(*[F.sum(v).alias(v) for v in names]).toArrow()  # features x width numbers
        out = np.zeros(q.shape)
        out[summed.column("i").to_numpy()] = np.stack([summed.column(v).to_numpy() for v in names], 1)
        shared.unpersist()
        return out

    try:
        q = np.linalg.qr(np.random.default_rng(seed).normal(size=(features, width)))[0]
        for _ in range(rounds):
            z = times(q)
            if not z.any():
                return np.zeros(k), np.zeros((features, k))
            q = np.linalg.qr(z)[0]
        values, vectors = np.linalg.eigh(q.T @ times(q))
    finally:
        weights.unpersist()
    order = np.argsort(values)[::-1][:k]
    right = q @ vectors[:, order]
    right *= np.where(right[np.abs(right).argmax(0), np.arange(right.shape[1])] < 0, -1, 1)
    return np.sqrt(np.maximum(values[order], 0)), right


def truncated_svd(df: DataFrame, text: str, k: int, features: int | None = None, rounds: int = 5, seed: int = 42, analyzer: str = "char_wb", low: int = 3, high: int = 4) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(singular values, right vectors, idf) of the hashed TF-IDF matrix of a text column."""
    features = features or SVD_BUCKETS
    lists = weighed_lists(df, F.lit(0), F.col(text), analyzer, low, high, features).persist()
    try:
        idf = idf_of(lists, features).get(0, np.ones(features))
        return *right_vectors(lists, idf, k, rounds, seed), idf
    finally:
        lists.unpersist()


def svd_transform(df: DataFrame, row_id: str, text: str, right: np.ndarray, idf: np.ndarray, analyzer: str = "char_wb", low: int = 3, high: int = 4) -> DataFrame:
    """(row_id, values): the TF-IDF rows of a text column times the right vectors."""
    sc = df.sparkSession.sparkContext
    shared = sc.broadcast((right, idf))

    @F.arrow_udf("array<double>")
    def embed(texts: pa.Array) -> pa.Array:
        (matrix, weights), each = shared.value, texts.dictionary_encode()  # equal texts have equal vectors
        vectors = _vectors(*_bucket_lists(each.dictionary, low, high, len(weights)), weights)
        out = _times(vectors, len(each.dictionary), matrix)[each.indices.to_numpy()]
        return pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1, dtype=np.int32) * out.shape[1]), pa.array(out.ravel()))

    return df.select(F.col(row_id).alias("row_id"), embed(_padded(F.col(text), analyzer)).alias("values"))
