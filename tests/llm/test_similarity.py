import random

from helpers import AWKWARD, documents

import corpus_pipeline
from planloom.llm import similarity, simhash


def edited(rng, words, share):
    return [f"x{rng.randrange(10**6)}" if rng.random() < share else w for w in words]


def corpus():
    rng, rows = random.Random(11), []
    for g in range(30):
        base = [f"w{rng.randrange(4000)}" for _ in range(rng.choice([40, 120, 400]))]
        for k in range(5):
            rows.append((1000 + 10 * g + k, " ".join(edited(rng, base, rng.choice([0, 0.005, 0.01, 0.02, 0.2])))))
    rows += [(2000 + i, " ".join(f"u{rng.randrange(4000)}" for _ in range(rng.randrange(1, 90)))) for i in range(60)]
    return rows + AWKWARD


def test_unlike_texts_stay_apart(spark):
    rng = random.Random(3)
    base = [f"w{i}" for i in range(100)]
    rows = [(i, " ".join(edited(rng, base, 0.3))) for i in range(40)]
    assert {r.doc_id for r in similarity.similar_groups(documents(spark, rows)).collect() if r.doc_id == r.component_id} == set(range(40))


def test_empty_and_one_stays(spark):
    assert similarity.similar_groups(documents(spark, [])).count() == 0
    docs = documents(spark, corpus())
    kept = simhash.drop_near_copies(docs, similarity.similar_groups(docs))
    assert kept.schema == docs.schema
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted({str(r.component_id) for r in similarity.similar_groups(docs).collect()})


def test_tiles_join_what_is_in_their_radius(spark, monkeypatch):
    """The near-copies stage links by SimHash tiles: it does so without its prefix filter; whole texts still decide."""
    rng, line = random.Random(5), "same menu line of every page here " * 60
    base = [f"v{rng.randrange(10**6)}" for _ in range(400)]
    near = [(10, " ".join(base)), (11, " ".join([*base, "tail"])), (12, " ".join(["head", *base]))]
    alike = [(20, line + " ".join(f"y{rng.randrange(10**6)}" for _ in range(60))), (21, line + " ".join(f"y{rng.randrange(10**6)}" for _ in range(60)))]
    bits = lambda a, b: (simhash.fingerprint(a[1].encode()) ^ simhash.fingerprint(b[1].encode())).bit_count()
    assert max(bits(near[0], r) for r in near) <= simhash.RADIUS and bits(*alike) <= simhash.RADIUS
    kept = similarity.stored
    monkeypatch.setattr(similarity, "stored", lambda df, label: kept(df.where("false") if label == "shared" else df, label))
    found = corpus_pipeline.near_copies(spark, documents(spark, near + alike), "")
    assert sorted(r.doc_id for r in found.collect()) == [10, 20, 21]
