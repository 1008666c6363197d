import hashlib

import numpy as np
from helpers import AWKWARD, documents

from planloom.llm import linededup
from planloom.llm.linededup import CuckooFilter, LineIndex

SPACE = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(c.lower() if c.isascii() else c for c in line.strip(SPACE))


def brute(rows):
    last = (1 << 63) - 1
    holders = {}
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 10:
                holders.setdefault(key(line), set()).add(last if doc is None else doc)
    out = []
    for doc, text in rows:
        me, lines = (last if doc is None else doc), (text or "").split("\n")
        kept = [x for x in lines if min(holders.get(key(x), {me})) == me]
        out.append((doc, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def digests(df):
    return sorted([tuple(r) for r in df.collect()], key=str)


def test_against_brute_force(spark):
    rows = AWKWARD + [(100 + i, f"a common passage line\nunique line number {i}\nline of pairs {i // 2}") for i in range(200)]
    assert digests(linededup.line_digests(documents(spark, rows))) == brute(rows)


def test_empty(spark):
    assert linededup.line_digests(documents(spark, [])).count() == 0
    assert linededup.drop_repeated_lines(documents(spark, [])).count() == 0


def test_insert_and_delete_are_reversible(spark):
    first, second = AWKWARD[:7], [(50, "one shared line of text\nbrand new line of fifty"), (51, "BRAND new line of fifty"), (52, "another line, only in two")]
    both = documents(spark, [*first, *second])
    index = LineIndex.empty(spark, 1000, keys_per_shard=300).insert(documents(spark, first))
    grown = index.insert(documents(spark, second))
    assert digests(linededup.line_digests(both, grown)) == brute([*first, *second])
    back = grown.delete(documents(spark, second).select("doc_id"))
    assert digests(linededup.line_digests(documents(spark, first), back)) == brute(first)
    blobs = lambda i: {r.shard: CuckooFilter.from_bytes(r.blob, i.buckets).tables[0].sum() for r in i.filters.collect()}
    assert {k: v for k, v in blobs(back).items() if v} == {k: v for k, v in blobs(index).items() if v}
    again = back.insert(documents(spark, second))
    assert digests(linededup.line_digests(both, again)) == brute([*first, *second])
    known = {r.hi for r in index.may_contain(documents(spark, first)).collect()}
    assert known == {r.hi for r in index.references.collect()}


def test_cuckoo_filter_has_no_false_negatives_when_overfull():
    rng = np.random.default_rng(1)
    keys = rng.integers(-(2**62), 2**62, 3000)
    held = CuckooFilter(64)
    codes = CuckooFilter.codes(keys, 64)
    for at in range(0, 3000, 500):
        held.insert(codes[at : at + 500])
    assert held.contains(codes).all()
    assert len(held.tables) > 1
    held = CuckooFilter.from_bytes(held.to_bytes(), 64)
    gone = np.setdiff1d(codes[:1000], codes[1000:])
    held.remove(gone)
    assert held.contains(codes[1000:]).all()
    wide = CuckooFilter(1 << 12)
    wide.insert(CuckooFilter.codes(keys, 1 << 12))
    assert wide.contains(CuckooFilter.codes(rng.integers(2**62, 2**63 - 1, 5000), 1 << 12)).mean() < 0.01


def test_texts_keep_columns(spark):
    docs = documents(spark, AWKWARD)
    out = linededup.drop_repeated_lines(docs)
    assert out.schema == docs.schema
    assert out.count() == len(AWKWARD)
    kept = {r.doc_id: r.text for r in out.collect()}
    assert kept[2] == "another line, only in two"
    assert kept[3] is None
    assert kept[4] == ""
