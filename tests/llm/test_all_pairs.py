"""Groups of near copies against all pairs of texts, and the rows that stay."""

import random

import pytest
from helpers import AWKWARD, documents
from test_similarity import corpus, edited

from planloom.llm import simhash, similarity


def all_pairs(rows):
    """The smallest id of each row's group: components of all pairs of similarity 0.8, texts without words in one."""
    sets, last = [similarity.shingles((t or "").encode()) for _, t in rows], 1 << 63
    root = list(range(len(rows)))
    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if root[i] != root[j] and len(x & y) >= 0.8 * len(x | y):
                old, new = root[i], root[j]
                root = [new if r == old else r for r in root]
    least = {}
    for (d, _), r in zip(rows, root, strict=True):
        least[r] = min(least.get(r, last), last if d is None else d)
    return sorted((str(d), str(None if least[r] == last else least[r])) for (d, _), r in zip(rows, root, strict=True))


def groups(spark, rows):
    return sorted((str(r.doc_id), str(r.component_id)) for r in similarity.similar_groups(documents(spark, rows)).collect())


@pytest.mark.parametrize("tile", [3, 4096])
def test_members_link_groups(spark, tile, monkeypatch):
    """Chains of copies: groups are linked by any of their members, not by those of the smallest ids."""
    monkeypatch.setattr(similarity, "TILE", tile, raising=False)
    rng, rows = random.Random(7), corpus()
    for g in range(20):
        words = [f"c{rng.randrange(5000)}" for _ in range(rng.choice([60, 150, 300]))]
        for k in rng.sample(range(8), 8):
            rows.append((5000 + 10 * g + k, " ".join(words)))
            words = edited(rng, words, 0.02)
    assert groups(spark, rows) == all_pairs(rows)


def test_equal_fingerprints_are_verified(spark):
    """A much repeated line decides the fingerprint, but texts that share only it are different."""
    rng, line = random.Random(1), "same menu line of every page here " * 60
    rows = [(i, line + " ".join(f"y{rng.randrange(10**6)}" for _ in range(60))) for i in range(12)]
    assert len({simhash.fingerprint(t.encode()) for _, t in rows}) < len(rows)
    assert groups(spark, rows) == all_pairs(rows) == sorted((str(i), str(i)) for i in range(12))


def test_no_distance_of_fingerprints_loses_a_pair(spark):
    """Equal shingle sets with other numbers of repeats, and a tail cut off: copies, at any distance of fingerprints."""
    rng, rows = random.Random(2), []
    for i in range(40):
        words = [f"z{rng.randrange(10**6)}" for _ in range(100)]
        head, tail = " ".join(words[:5]), " ".join(words[80:] + words[80:])
        rows += [(10 * i, " ".join([head] * 2 + words)), (10 * i + 1, " ".join([head] * 60 + words)), (10 * i + 5, tail * 2), (10 * i + 6, " ".join(words[:84]))]
    far = [(simhash.fingerprint(a.encode()) ^ simhash.fingerprint(b.encode())).bit_count() for (_, a), (_, b) in zip(rows[::4], rows[1::4], strict=True)]
    assert max(far) > 13
    assert groups(spark, rows) == all_pairs(rows)


def test_groups_without_or_with_repeated_ids_stay(spark):
    rng = random.Random(4)
    texts = [" ".join(f"n{rng.randrange(10**6)}" for _ in range(50)) for _ in range(9)]
    rows = [(None, t) for t in texts[:5]] + [(None, texts[0])] + [(7, t) for t in texts[5:]] + [(7, texts[5]), (8, texts[5])]
    docs = documents(spark, [*rows, *AWKWARD[:3]])
    expected = sorted([*texts, AWKWARD[0][1], AWKWARD[1][1], ""])
    for found in (None, similarity.similar_groups(docs)):
        kept = simhash.drop_near_copies(docs, found)
        assert kept.schema == docs.schema
        assert sorted(r.text or "" for r in kept.collect()) == expected
