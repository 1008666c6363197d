import zlib

import pytest
from helpers import AWKWARD, documents

from planloom.llm import sharding


def brute(rows, shards, vnodes):
    """The ring key by key."""
    nodes = sharding.ring(shards, vnodes)
    keyed = []
    for doc, text in rows:
        pos = sharding.ring_position("null" if doc is None else str(doc))
        arc = next((i for i, (p, _) in enumerate(nodes) if p >= pos), 0)
        data = (text or "").encode()
        part = (zlib.crc32(data) + len(data) + 8) % sharding.PARTS
        keyed.append((arc, pos, doc is not None, doc or 0, len(data) + 8, zlib.crc32(data), doc, part))
    keyed.sort(key=lambda k: (k[0], k[7], *k[1:6]))
    caps = [len(rows) // shards + (s < len(rows) % shards) for s in range(shards)]
    held, over = [[] for _ in range(shards)], []
    for k in keyed:
        home = nodes[k[0]][1]
        (held[home] if len(held[home]) < caps[home] else over).append(k)
    for k in over:
        at = k[0]
        while True:
            at = (at + 1) % len(nodes)
            if len(held[nodes[at][1]]) < caps[nodes[at][1]]:
                held[nodes[at][1]].append(k)
                break
    return sorted((k[6] is not None, k[6] or 0, k[4], k[5], s, n) for s, ks in enumerate(held) for n, k in enumerate(ks))


@pytest.mark.parametrize(("shards", "vnodes"), [(3, 4), (24, 128)])
def test_as_the_ring_key_by_key(spark, shards, vnodes):
    rows = AWKWARD + [(i, f"text {i % 7}") for i in range(100, 700)]
    got = sharding.assign_shards(documents(spark, rows), shards, vnodes).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0, r["size"], r.text_crc32, r.shard, r.slot) for r in got) == brute(rows, shards, vnodes)
    sizes = [sum(r.shard == s for r in got) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1
    for s in range(shards):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sizes[s]))
    assert {r.law for r in got} == {"rows"}
    assert all(r.grown_shard is None for r in got)


def test_a_key_of_a_third_of_the_rows(spark, monkeypatch):
    """Rows without a doc_id, of many texts and of one, are ranked in parts and put out in runs."""
    monkeypatch.setattr(sharding, "RUN", 50)
    rows = [(None, f"text {i}") for i in range(300)] + [(None, "one")] * 333 + [(i, "other") for i in range(400)]
    got = sharding.assign_shards(documents(spark, rows), 5, 16).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0, r["size"], r.text_crc32, r.shard, r.slot) for r in got) == brute(rows, 5, 16)


def test_empty_and_few(spark):
    assert sharding.assign_shards(documents(spark, [])).count() == 0
    assert sharding.assign_shards(documents(spark, [(1, "a")])).first().slot == 0


def test_movement_with_slack_is_limited(spark):
    rows = [(i, "x") for i in range(3000)]
    place = lambda n: {r.doc_id: r.shard for r in sharding.assign_shards(documents(spark, rows), n, slack=0.25).collect()}
    before, after = place(10), place(11)
    assert sum(before[d] != after[d] for d in before) < 3000 * 0.25


def test_only_jvm_operators(spark):
    plan = sharding.assign_shards(documents(spark, AWKWARD))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan
    assert "Arrow" not in plan
