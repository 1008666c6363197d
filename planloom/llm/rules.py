"""Adaptive quality rules, in DataFrame operations only.

Each text is measured once, in one projection. Every measure goes into a mergeable quantile sketch per language and
source: counts of logarithmic buckets (DDSketch), which a plain sum merges and which give any quantile within a fixed
relative error. The sketches of sources are merged into those of languages and of everything; a group with too few rows
takes its thresholds from the next larger one. Thresholds are fences around the middle half of a group's rows, and a join
on language and source filters the rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planloom.llm.common import stored

WORD_PATTERN = r"[^\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5
#: Relative distance of neighbouring buckets.
GAMMA = 1.02
#: Rows a group needs for thresholds of its own.
MIN_ROWS = 200
#: Fences are this many spreads from the quartiles.
REACH = 4.0
#: measure -> (smallest spread, whether low values are suspicious too)
MEASURES = {
    "symbols_per_word": (0.05, False),
    "dup_line_share": (0.10, False),
    "repeat_share": (0.045, False),
    "mean_word_length": (0.90, True),
}
_TEXT_COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words"]


def _let(value: Column, body) -> Column:
    """Evaluates ``value`` once for a row and gives it to ``body``."""
    return F.transform(F.array(value), body)[0]


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words that lie in windows found twice or more in ``words``."""

    def marked(hashes: Column) -> Column:
        by_hash = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def places(pairs: Column) -> Column:
            twin = lambda x, k: F.coalesce(F.get(pairs, k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(pairs, k + 1)["h"] == x["h"], F.lit(False))
            return F.sort_array(F.transform(F.filter(pairs, twin), lambda x: x["i"]))

        start = F.struct(F.lit(-window).cast("int").alias("last"), F.lit(0).cast("bigint").alias("n"))
        step = lambda a, p: F.struct(p.cast("int").alias("last"), (a["n"] + F.least(F.lit(window), p - a["last"])).cast("bigint").alias("n"))
        return F.aggregate(_let(by_hash, places), start, step, lambda a: a["n"])

    def counted(hashes: Column) -> Column:
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("bigint")).otherwise(marked(hashes))

    hashes = F.transform(F.sequence(F.lit(1), F.size(words) - (window - 1)), lambda i: F.xxhash64(F.slice(words, i, window)))
    return F.when(F.size(words) < window, F.lit(0).cast("bigint")).otherwise(_let(hashes, counted))


def measures(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts of each text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    space = r"[\x20\x09-\x0D]"
    words = F.filter(F.split(text, space + "+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.btrim(x, F.lit(" \t\n\x0b\x0c\r"))) > 0)
    of_words = _let(words, lambda w: F.struct(F.size(w).cast("bigint").alias("n_words"), F.length(F.array_join(w, "")).cast("bigint").alias("word_chars"), repeated_words(w).alias("n_repeat_words")))
    of_lines = _let(lines, lambda x: F.struct(F.size(x).cast("bigint").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines")))
    symbols = (F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))).cast("bigint")
    found = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), of_words.alias("w"), of_lines.alias("l"), symbols.alias("n_symbols"))
    return found.select("doc_id", "lang", "source", "w.*", "l.*", "n_symbols")


def _values() -> dict[str, Column]:
    per = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return {
        "symbols_per_word": per("n_symbols", "n_words"),
        "dup_line_share": per("n_dup_lines", "n_lines"),
        "repeat_share": per("n_repeat_words", "n_words"),
        "mean_word_length": per("word_chars", "n_words"),
    }


def bucket(value: Column, gamma: float = GAMMA) -> Column:
    """Number of the sketch's bucket; zero has the lowest."""
    return F.when(value > 0, F.ceil(F.ln(value) / F.lit(math.log(gamma))).cast("int")).otherwise(F.lit(-100000))


def bucket_value(number: Column, gamma: float = GAMMA) -> Column:
    return F.when(number == -100000, F.lit(0.0)).otherwise(F.pow(F.lit(gamma), number) * F.lit(2 / (1 + gamma)))


def sketches(measured: DataFrame) -> DataFrame:
    """(lang, source, measure, bucket, n): sums of ``n`` merge the sketches of any groups."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("measure"), bucket(v).alias("bucket")) for k, v in _values().items()]))
    rows = measured.where("n_words > 0").select("lang", "source", each.alias("m"))
    return rows.groupBy("lang", "source", "m.measure", "m.bucket").agg(F.count("*").alias("n"))


def fences(sketch: DataFrame) -> DataFrame:
    """(lang, source, rows, low, high): maps from measure to fence."""
    group = ["lang", "source", "measure"]
    running = Window.partitionBy(*group).orderBy("bucket")
    ranked = sketch.withColumn("upto", F.sum("n").over(running)).withColumn("total", F.sum("n").over(Window.partitionBy(*group)))
    at = lambda q: bucket_value(F.min(F.when(F.col("upto") >= q * F.col("total"), F.col("bucket")))).alias(f"q{int(100 * q)}")
    found = ranked.groupBy(*group).agg(F.max("total").alias("rows"), at(0.25), at(0.5), at(0.75))
    least = F.create_map(*[F.lit(x) for k, (s, _) in MEASURES.items() for x in (k, s)])
    both = F.create_map(*[F.lit(x) for k, (_, b) in MEASURES.items() for x in (k, b)])
    spread = least[F.col("measure")]
    high = F.col("q75") + REACH * F.greatest(F.col("q75") - F.col("q50"), spread)
    low = F.when(both[F.col("measure")], F.col("q25") - REACH * F.greatest(F.col("q50") - F.col("q25"), spread))
    pair = F.struct("measure", low.alias("low"), high.alias("high"))
    return found.withColumn("fence", pair).groupBy("lang", "source").agg(F.max("rows").alias("rows"), F.collect_list("fence").alias("fences"))


def thresholds(measured: DataFrame, min_rows: int = MIN_ROWS) -> DataFrame:
    """(lang, source, fences) of every group, from the group, its language, or all rows."""
    by_source = stored(sketches(measured), "sketches")
    merged = lambda df, *keys: df.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))
    by_lang = merged(by_source, "lang").withColumn("source", F.lit(""))
    everything = merged(by_source).withColumn("lang", F.lit("")).withColumn("source", F.lit(""))
    own = fences(by_source)
    lang = fences(by_lang).select(F.col("lang").alias("of_lang"), F.col("rows").alias("lang_rows"), F.col("fences").alias("lang_fences"))
    joined = own.join(lang, F.col("lang").eqNullSafe(F.col("of_lang"))).withColumn("all_fences", fences(everything).select("fences").scalar())
    pick = F.when(F.col("rows") >= min_rows, F.col("fences")).when(F.col("lang_rows") >= min_rows, F.col("lang_fences")).otherwise(F.col("all_fences"))
    return joined.select("lang", "source", pick.alias("fences"))


def judge(docs: DataFrame, min_rows: int = MIN_ROWS) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, failed of every row.

    ``failed`` lists the measures outside their fences. A null or empty text has no words and fails the base rules; a null
    language or source is a group of its own; repeated rows are judged each; an empty table gives no rows; other columns
    are ignored. A group of fewer than ``min_rows`` rows with words takes its language's thresholds, and a language of fewer
    those of all rows. Windows are told apart by 64 bits of their words.
    """
    measured = stored(measures(docs), "measures")
    limits = stored(thresholds(measured, min_rows), "thresholds")
    limits = limits.select(F.col("lang").alias("g_lang"), F.col("source").alias("g_source"), "fences")
    value = F.create_map(*[x for k, v in _values().items() for x in (F.lit(k), v)])
    outside = lambda f: (F.col("values")[f["measure"]] > f["high"]) | F.coalesce(F.col("values")[f["measure"]] < f["low"], F.lit(False))
    judged = measured.join(limits, F.col("lang").eqNullSafe(F.col("g_lang")) & F.col("source").eqNullSafe(F.col("g_source")), "left").withColumn("values", value)
    judged = judged.withColumn("failed", F.coalesce(F.transform(F.filter("fences", outside), lambda f: f["measure"]), F.array().cast("array<string>")))
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return judged.withColumn("base_failed", base).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.size("failed") == 0)).alias("kept"), F.array_sort("failed").alias("failed"))
