import random

import numpy as np
import pytest
import xxhash
from helpers import AWKWARD, documents

from planloom.llm import simhash
from planloom.llm.components import connected_components


def slow_fingerprint(text):
    ws = "".join(c.lower() if c.isascii() else c for c in text or "").replace("\x0b", " ").replace("\x0c", " ").replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ")
    ws = [w for w in ws if w]
    hs = [xxhash.xxh64_intdigest(" ".join(ws[i : i + 3]).encode(), 42) for i in range(max(1, len(ws) - 2))] if ws else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def slow_components(pairs):
    """pairs: (doc, fingerprint)."""
    last = 1 << 63
    root = list(range(len(pairs)))
    for i in range(len(pairs)):
        for j in range(i):
            if (pairs[i][1] ^ pairs[j][1]).bit_count() <= 3:
                a, b = root[i], root[j]
                root = [b if r == a else r for r in root]
    least = {}
    for (d, _), r in zip(pairs, root, strict=True):
        least[r] = min(least.get(r, last), last if d is None else d)
    return [None if least[r] == last else least[r] for r in root]


def copies():
    rng = random.Random(5)
    base = [f"w{rng.randrange(300)}" for _ in range(400)]
    rows = [(500 + i, " ".join(base[:i] + [f"new{i}"] + base[i:])) for i in range(0, 60)]
    return rows + [(900 + i, " ".join(f"u{rng.randrange(4)}" for _ in range(6))) for i in range(60)] + [(990, "Two words"), (991, "two WORDS"), (992, "one")]


@pytest.mark.parametrize("tile", [8, simhash.TILE])
def test_against_all_pairs(spark, tile, monkeypatch):
    monkeypatch.setattr(simhash.near_links, "__defaults__", (3, tile))
    rows = [r for r in AWKWARD if r[0] not in (8, 9)] + copies()
    pairs = [(d, slow_fingerprint(t)) for d, t in rows]
    expected = sorted((str(d), f"{f:016x}", str(c)) for (d, f), c in zip(pairs, slow_components(pairs), strict=True))
    got = sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in simhash.fingerprint_digests(documents(spark, rows)).collect())
    assert got == expected


def test_chains_across_tiles(spark):
    """Random fingerprints with chains of near ones: every link is found, also between tiles."""
    rng = np.random.default_rng(2)
    fps = set()
    for _ in range(150):
        f = int(rng.integers(0, 1 << 63, dtype=np.uint64)) * 2
        for _ in range(int(rng.integers(1, 12))):
            fps.add(f)
            for b in rng.integers(0, 64, int(rng.integers(1, 4))):
                f ^= 1 << int(b)
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp bigint")
    links = simhash.near_links(df, 3, 16)
    got = {r.node: r.root for r in connected_components(links).collect()}
    expected = slow_components(list(zip(signed, fps, strict=True)))
    assert [got.get(s, s) for s in signed] == [c for c in expected]


def test_one_of_each_group_stays(spark):
    docs = documents(spark, AWKWARD + copies())
    kept = simhash.drop_near_copies(docs)
    assert kept.columns == docs.columns
    groups = simhash.near_groups(docs).collect()
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted({str(r.component_id) for r in groups})


def test_empty(spark):
    assert simhash.fingerprint_digests(documents(spark, [])).count() == 0
    assert simhash.drop_near_copies(documents(spark, [])).count() == 0


def test_components_of_a_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(1000, 1000 + i) for i in range(1, 50)] + [(7, 7)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{1000 + i: 1000 for i in range(50)}}
