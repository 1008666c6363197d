import hashlib
import re

from helpers import AWKWARD, documents

from planloom.llm import decontamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def tokens(text):
    return WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def brute(rows, items):
    windows = []
    for item, text in items:
        ws = tokens(text)
        n = min(13, len(ws))
        windows += [("null" if item is None else str(item), ws[i : i + n]) for i in range(len(ws) - n + 1) if n]
    out = []
    for doc, text in rows:
        ws, hit, named = tokens(text), set(), set()
        for item, w in windows:
            for i in range(len(ws) - len(w) + 1):
                if ws[i] == w[0] and ws[i : i + len(w)] == w:
                    hit |= set(range(i, i + len(w)))
                    named.add(item)
        out.append((doc, len(ws), len(hit), len(named), hashlib.sha256(",".join(sorted(named)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(ws)))
    return sorted(out, key=str)


PASSAGE = " ".join(f"w{i}" for i in range(20))
ITEMS = [(1, PASSAGE), (10, "Short item, OF five words"), (2, ""), (3, None), (4, "café"), (None, "nullish item words here"), (1, PASSAGE.upper()), (5, "a a a a a a a a a a a a a a a a")]
ROWS = [
    *AWKWARD,
    (20, f"before {PASSAGE} after"),
    (21, PASSAGE.replace("w10", "other")),
    (22, " ".join(PASSAGE.split()[:13])),
    (23, " ".join(PASSAGE.split()[:12])),
    (24, "x short ITEM - of five words! short item of five words"),
    (25, " ".join(["pad"] * 400) + f" {PASSAGE}"),
    (26, " ".join(["a"] * 40)),
    (27, "nullish item words here"),
    (28, f"{PASSAGE} {PASSAGE}"),
    (29, "w0 w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11"),
    (30, "w12 w13 w14"),
]


def test_against_brute_force(spark, monkeypatch):
    docs, items = documents(spark, ROWS), spark.createDataFrame(ITEMS, "item_id bigint, text string")
    expected = brute(ROWS, ITEMS)
    for words in (decontamination.BLOCK_WORDS, 20):
        monkeypatch.setattr(decontamination.test_blocks, "__defaults__", (13, words))
        got = sorted([tuple(r) for r in decontamination.find_matches(docs, items).drop("matches").collect()], key=str)
        assert got == expected
    clean = decontamination.remove_contaminated(docs, items)
    assert clean.schema == docs.schema
    assert sorted(str(r.doc_id) for r in clean.collect()) == sorted(str(e[0]) for e in expected if not e[5])


def test_longest_matches_and_places(spark):
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    rows = {r.doc_id: r.matches for r in decontamination.find_matches(documents(spark, ROWS), items).collect()}
    assert [tuple(m) for m in rows[20]] == [("1", 0, 1, 20)]
    assert [tuple(m) for m in rows[28]] == [("1", 0, 0, 20), ("1", 0, 20, 20)]


def test_real_tables(spark, data):
    docs, items = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/benchmark.parquet")
    got = sorted([tuple(r) for r in decontamination.find_matches(docs, items).drop("matches").collect()], key=str)
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])


def test_empty(spark):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert decontamination.find_matches(documents(spark, []), none).count() == 0
    assert decontamination.remove_contaminated(documents(spark, ROWS), none).count() == len(ROWS)
