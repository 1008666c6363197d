import re
from collections import Counter

from helpers import AWKWARD, documents

from planloom.llm import rules
from planloom.llm.queries import ORACLES

WORD, SYMBOL = re.compile(r"[^\x20\x09-\x0D]+"), re.compile(rules.SYMBOLS)


def brute(text):
    text = text or ""
    ws = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    grams = [tuple(ws[i : i + 5]) for i in range(len(ws) - 4)]
    n = Counter(grams)
    twice = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(5)}
    return len(ws), sum(map(len, ws)), len(SYMBOL.findall(text)), len(lines) - len(set(lines)), len(twice)


REPEATS = [(70, "a b c d e f a b c d e g h i j k l"), (71, "x " * 50), (72, "one two three four five\none two three four five\n" * 3), (73, "a b c d"), (74, "a b c d e"), (75, "t u v w x y z t u v w x y z t u v w x y z q"), (76, " | # $".join(f"w{i}" for i in range(60)))]


def test_counts_against_brute_force(spark):
    rows = AWKWARD + REPEATS
    got = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rules.judge(documents(spark, rows)).collect()), key=str)
    assert got == sorted(((d, *brute(t)) for d, t in rows), key=str)


def test_base_rules_and_fences(spark):
    clean = [(1000 + i, " ".join(f"plain{(i * 7 + k) % 91}" for k in range(40 + i % 9))) for i in range(300)]
    junk = [(2000 + i, " ".join(f"odd{(i * 5 + k) % 83}$%" for k in range(40))) for i in range(20)]
    out = {r.doc_id: r for r in rules.judge(documents(spark, clean + junk + REPEATS)).collect()}
    assert all(out[d].kept for d, _ in clean)
    assert all(not out[d].kept and not out[d].base_failed and out[d].failed == ["symbols_per_word"] for d, _ in junk)
    assert out[71].base_failed
    assert not out[71].kept


def test_each_measure_rejects_what_the_base_keeps(spark):
    clean = [(1000 + i, " ".join(f"plain{(i * 7 + k) % 91}" for k in range(40 + i % 9))) for i in range(300)]
    word = lambda k: f"plain{k}"
    odd = {
        "symbols_per_word": " ".join(f"{word(k)}$%" for k in range(40)),
        "dup_line_share": "\n".join(x for k in range(40) for x in ("ab", word(k))),
        "repeat_share": " ".join([*map(word, range(9)), *map(word, range(20, 97)), *map(word, range(9))]),
        "mean_word_length": " ".join(f"{word(k)}{'long' * 9}" for k in range(40)),
    }
    rows = clean + [(i, t) for i, t in enumerate(odd.values())]
    out = {r.doc_id: r for r in rules.judge(documents(spark, rows)).collect()}
    for i, name in enumerate(odd):
        assert not out[i].base_failed
        assert not out[i].kept
        assert name in out[i].failed
    assert all(out[d].kept for d, _ in clean)


def test_null_groups_and_empty(spark):
    assert rules.judge(documents(spark, [])).count() == 0
    df = spark.createDataFrame([(1, "some words here " * 5, None, None), (None, None, "en", None), (2, "ten words " * 5, None, "s")], "doc_id bigint, text string, lang string, source string")
    assert rules.judge(df).count() == 3


def test_null_and_empty_groups_have_their_own_thresholds(spark):
    """A null language, an empty one, and each pair with a source are groups; a small group takes its language's."""
    plain, odd = " ".join(f"w{k}" for k in range(40)), " ".join(f"w{k}$%" for k in range(40))
    rows = [(i, plain, None, "s") for i in range(60)] + [(100 + i, odd, "", "s") for i in range(60)] + [(200, odd, None, "s"), (300, odd, "", None), (301, plain, "", None), (400, odd, "en", None)]
    got = {r.doc_id: r.kept for r in rules.judge(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string"), min_rows=50).collect()}
    assert not got[200]
    assert got[300]
    assert all(got[i] for i in range(60)) and all(got[100 + i] for i in range(60))


def test_sketches_merge_and_bound_the_error(spark):
    df = spark.createDataFrame([(float(v),) for v in range(1, 2001)], "v double")
    from pyspark.sql import functions as F

    back = df.select("v", rules.bucket_value(rules.bucket(F.col("v"))).alias("b")).collect()
    assert max(abs(r.b / r.v - 1) for r in back) < 0.0101
    assert df.select(rules.bucket_value(rules.bucket(F.lit(0.0))).alias("b")).first().b == 0


def test_against_sql(spark, data, duck):
    got = sorted(tuple(r) for r in rules.judge(spark.read.parquet(f"{data}/documents.parquet")).drop("failed").collect())
    assert got == sorted(duck.execute(ORACLES["op3_adaptive_rules"]).fetchall())


def test_only_jvm_operators(spark):
    plan = rules.judge(documents(spark, AWKWARD))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan
    assert "Arrow" not in plan
