import zlib

import numpy as np
import pytest
from helpers import AWKWARD, documents

from planloom.llm import bytecnn


def slow_logit(net, text):
    """One text, filter by filter and chunk by chunk."""
    w = net.weights
    data = text.ljust(bytecnn.halves(len(text)) * 256, b"\0") + b"\0" * 4
    outs = []
    for at in range(0, len(data) - 4, 4):
        seen = w["embed"][np.frombuffer(data[at : at + 8], np.uint8)].astype(np.float64).ravel()
        outs.append(seen @ np.concatenate([w["left"], w["right"]]).astype(np.float64))
    halves = [np.max(outs[k * 64 : k * 64 + 64], axis=0) for k in range(len(outs) // 64)]
    chunks = [np.maximum(a, b) for a, b in zip(halves, halves[1:], strict=False)] or halves
    values = [np.maximum(np.maximum(c + w["bias"], 0) @ w["hidden"] + w["hidden_bias"], 0) @ w["out"] + w["out_bias"][0] for c in chunks]
    return float(np.mean(values))


@pytest.fixture(scope="module")
def net():
    rng = np.random.default_rng(0)
    texts = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta"], 60)).encode() if k % 2 else b"$$$ %%% junk " * 30 for k in range(60)]
    return bytecnn.train(texts, np.array([k % 2 for k in range(60)], np.float32), prior=0.3, epochs=4)


def test_whole_texts_against_brute_force(net, monkeypatch):
    texts = [b"", b"a", b"x" * 255, b"y" * 256, b"z" * 257, "é".encode() * 700, bytes(range(256)) * 9, b"alpha beta " * 500]
    expected = [slow_logit(net, t) for t in texts]
    assert np.allclose(net.logits(texts), expected, atol=1e-4)
    monkeypatch.setattr(bytecnn, "SEGMENT", 1024)
    assert np.allclose(net.logits(texts), expected, atol=1e-4)
    assert np.allclose(net.logits(texts[::-1]), expected[::-1], atol=1e-4)


def test_gradients_against_differences(net):
    texts, labels = [b"alpha beta gamma " * 40, b"%%% junk" * 9], np.array([1.0, 0.0], np.float32)

    def loss():
        z = np.array([slow_logit(net, t) for t in texts])
        return float(np.mean(np.log1p(np.exp(z)) - labels * z))

    grads = bytecnn._gradients(net, texts, labels)
    for name, at in (("left", (3, 5)), ("right", (7, 1)), ("embed", (97, 2)), ("hidden", (4, 3)), ("out", (2,)), ("bias", (6,)), ("hidden_bias", (1,))):
        w, keep = net.weights[name], float(net.weights[name][at])
        w[at] = keep + 1e-3
        up = loss()
        w[at] = keep - 1e-3
        down = loss()
        w[at] = keep
        assert abs((up - down) / 2e-3 - grads[name][at]) < 2e-3 + 0.05 * abs(grads[name][at]), name


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    scored = {r.doc_id: r for r in bytecnn.score_quality(docs, labels).collect()}
    assert len(scored) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 4 == 2) for d, r in scored.items())
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in scored.values())
    judged = [(r.quality, scored[r.doc_id]) for r in labels.collect() if scored[r.doc_id].held_out]
    assert np.mean([q == s.predicted for q, s in judged]) > 0.93
    good, bad = [s.score for q, s in judged if q], [s.score for q, s in judged if not q]
    assert np.mean([a > b for a in good for b in bad]) > 0.95


def test_held_out_labels_are_never_learned(spark):
    rows = [(i, f"text number {i} " * 9 if i % 2 else "%%% $$$ junk " * 9) for i in range(60)]
    docs = documents(spark, rows)
    true = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id bigint, quality int")
    wrong = spark.createDataFrame([(i, i % 2 if zlib.crc32(str(i).encode()) % 4 != 2 else 1 - i % 2) for i in range(60)], "doc_id bigint, quality int")
    score = lambda labels: sorted(tuple(r) for r in bytecnn.score_quality(docs, labels).collect())
    assert score(true) == score(wrong)


def test_awkward_and_empty(spark):
    docs, none = documents(spark, AWKWARD), spark.createDataFrame([], "doc_id bigint, quality int")
    rows = bytecnn.score_quality(docs, none).collect()
    assert len(rows) == len(AWKWARD)
    assert {r.score for r in rows} == {0.5}
    assert bytecnn.keep_accepted(docs, none).count() == len(AWKWARD)
    labels = spark.createDataFrame([(d, int(d % 2)) for d, _ in AWKWARD if d is not None] + [(1, None), (None, 1), (1, 0)], "doc_id bigint, quality int")
    rows = bytecnn.score_quality(docs, labels).collect()
    assert len(rows) == len(AWKWARD)
    assert len({r.score for r in rows if r.doc_id in (3, 4)}) == 1
    assert bytecnn.keep_accepted(docs, labels).schema == docs.schema
    assert bytecnn.score_quality(documents(spark, []), labels).count() == 0
