"""Counts of n-grams: long texts, texts of one row in several, and rows with the same id."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from planloom.operators import text


def expected(pairs, low, high, pad=""):
    out = Counter()
    for i, s in pairs:
        t = f"{pad}{s or ''}{pad}"
        out.update((i, t[k : k + n]) for n in range(low, high + 1) for k in range(len(t) - n + 1))
    return out


def counted(df):
    rows = df.collect()
    out = {(r.row_id, r.token): r.tf for r in rows}
    assert len(out) == len(rows)
    return out


ODD = [(1, "abab"), (2, None), (1, "ab"), (None, "x😀é你好 x"), (3, ""), (None, "x😀"), (4, "a"), (5, "a\n\x00b" * 9), (2, "zz")]


@pytest.mark.parametrize("at_once", [3, 1 << 19])
@pytest.mark.parametrize("analyzer, pad, low, high", [("char", "", 2, 3), ("char_wb", " ", 3, 4), ("char", "", 1, 1)])
def test_counts_of_odd_rows(spark, monkeypatch, at_once, analyzer, pad, low, high):
    monkeypatch.setattr(text, "AT_ONCE", at_once)
    df = spark.createDataFrame(ODD, "k long, s string")
    assert counted(text.token_counts(df, "k", "s", analyzer, low, high)) == expected(ODD, low, high, pad)


def test_hashed_counts_add_up(spark):
    df = spark.createDataFrame(ODD, "k long, s string")
    own = text.token_counts(df, "k", "s").groupBy("row_id", text.hash_bucket(F.col("token"), 16).alias("token")).agg(F.sum("tf").alias("tf"))
    assert counted(text.token_counts(df, "k", "s", buckets=16)) == counted(own)


def test_many_letters(spark):
    """More letters than one number has room for n-grams of."""
    r = np.random.default_rng(1)
    pairs = [(i, "".join(map(chr, r.integers(0x4E00, 0x9FFF, 4000)))) for i in range(12)]
    df = spark.createDataFrame(pairs, "k long, s string").coalesce(1)
    assert counted(text.token_counts(df, "k", "s", "char", 4, 5)) == expected(pairs, 4, 5)


def test_long_text_takes_linear_time(spark):
    """Cutting n-grams at character positions in UTF-8 takes time with the square of the length: minutes for this text."""
    pairs = [(1, "".join(map(chr, np.random.default_rng(1).integers(97, 123, 1_500_000))))]
    found = counted(text.token_counts(spark.createDataFrame(pairs, "k long, s string"), "k", "s", "char", 2, 3))
    assert found == expected(pairs, 2, 3)


def test_n_grams_are_not_shuffled(spark):
    plan = text.token_counts(spark.createDataFrame(ODD, "k long, s string"), "k", "s")._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and "Generate" not in plan


def test_norms_are_not_broadcast(spark):
    """All rows' norms went to the driver, when they were small enough compressed."""
    df = spark.createDataFrame([(i, f"{i % 7} red ring") for i in range(5000)], "k long, s string")
    n, parts = text.extent(df, "s")
    assert n == 5000
    counts = text.token_counts(df, "k", "s", parts=parts)
    weights = text.tfidf(counts, text.inverse_frequency(counts, n), parts)
    assert weights.groupBy("row_id").agg(F.sum(F.col("value") * F.col("value")).alias("l")).where("abs(l - 1) > 1e-9").count() == 0
    assert weights._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1


def test_partitions_follow_the_length(spark, monkeypatch):
    monkeypatch.setattr(text, "PART_CHARACTERS", 100)
    df = spark.createDataFrame([(i, "red ring") for i in range(500)], "k long, s string").coalesce(1)
    assert text.extent(df, "s") == (500, 50)
    assert text.token_counts(df, "k", "s").rdd.getNumPartitions() == 50


def test_fits_take_equal_texts_once(spark):
    """All passes of a fit went over the n-grams of every row."""
    texts = [f"text {i % 7} of some {i % 3}" for i in range(2000)] + [None, ""]
    df = spark.createDataFrame([(t,) for t in texts], "s string").coalesce(1)
    lists = text.weighed_lists(df, F.lit(0), F.col("s"), "char_wb", 3, 4, 256).collect()
    assert sum(r.w for r in lists) == 2002 and len(lists) == 22
    idf = text.idf_of(text.weighed_lists(df, F.lit(0), F.col("s"), "char_wb", 3, 4, 256), 256)[0]
    buckets = df.select(F.array_distinct(F.transform(text.ngrams(F.col("s"), "char_wb"), lambda t: text.hash_bucket(t, 256))).alias("b")).select(F.explode("b").alias("b"))
    own = np.zeros(256)
    for r in buckets.groupBy("b").count().collect():
        own[r.b] = r["count"]
    assert np.allclose(idf, np.log((1 + 2002) / (1 + own)) + 1)
