"""run() against the stages done by brute force, one after the other."""

import random
import zlib

import numpy as np
import test_all_pairs
import test_bytecnn
import test_decontamination
import test_linededup
from helpers import AWKWARD, documents

import corpus_pipeline
from planloom.llm import bytecnn
from planloom.llm.queries import vocabulary_path


def corpus():
    rng = random.Random(8)
    words = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in ("ling", "ter", "mon", "s")]
    prose = lambda n: " ".join(rng.choices(words, k=n))
    rows = [(i, f"{prose(60)}.\nA shared line of every text.\n{prose(40)}.") for i in range(100, 160)]
    rows += [(i, f"{prose(20)}$$$ %%% ### junk junk junk " * 6) for i in range(200, 230)]
    rows += [(300 + k, t) for k, (_, t) in enumerate(rows[:8])]  # exact copies
    rows += [(400, f"{prose(30)} {test_decontamination.PASSAGE} {prose(30)}"), (401, test_decontamination.PASSAGE)]
    return rows + AWKWARD


def test_against_brute_force(spark, tmp_path):
    rows = corpus()
    documents(spark, rows).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(d, int(not 200 <= d < 230), 0) for d, _ in rows if d is not None and d % 3], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(test_decontamination.ITEMS, "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    net = bytecnn.fit(spark.read.parquet(str(tmp_path / "documents.parquet")), spark.read.parquet(str(tmp_path / "labels.parquet")))
    chance = lambda t: 1 / (1 + np.exp(-test_bytecnn.slow_logit(net, (t or "").encode()) - net.prior))
    left = [(d, t) for d, t in rows if chance(t) >= 0.7]
    assert 50 < len(left) < len(rows) - 20
    last = (1 << 63) - 1
    holders = {}
    for d, t in left:
        for line in (t or "").split("\n"):
            if len(test_linededup.key(line)) >= 10:
                holders.setdefault(test_linededup.key(line), set()).add(last if d is None else d)
    lined = []
    for d, t in left:
        me = last if d is None else d
        kept = [x for x in (t or "").split("\n") if min(holders.get(test_linededup.key(x), {me})) == me]
        lined.append((d, t if t is None else "\n".join(kept)))
    least = {}
    for (d, t), group in zip(sorted(lined, key=lambda r: str(r[0])), test_all_pairs.all_pairs(lined), strict=True):
        assert str(d) == group[0]
        if group[0] == group[1]:
            least.setdefault(d, t)
    single = least
    bad = {r[0] for r in test_decontamination.brute(list(single.items()), test_decontamination.ITEMS) if r[5]}
    expected = {d: t for d, t in single.items() if d not in bad}
    assert bad

    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary_path())
    found = {}
    for p in pieces:
        found.setdefault(p.doc_id, []).append(p)
    assert set(found) == set(expected)
    for d, t in expected.items():
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for p in sorted(found[d], key=lambda p: p.start):
            assert p.start == at
            assert p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)


def test_stages_keep_the_columns(spark, tmp_path):
    docs = documents(spark, corpus()[:40])
    spark.createDataFrame([], "doc_id bigint, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "lines", "near_copies", "decontaminate", "pack"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).schema == docs.schema
