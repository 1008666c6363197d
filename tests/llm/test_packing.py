import zlib

import numpy as np
import pytest
from helpers import AWKWARD, documents

from planloom.llm import packing
from planloom.llm.queries import vocabulary_path


def check(pieces, rows, tokenizer):
    """Every id of every document lies in one piece, and the pieces fill their sequences without gaps."""
    texts = {d: t for d, t in rows}
    ids = {d: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for d, t in texts.items()}
    copies = {d: sum(x == d for x, _ in rows) for d, _ in rows}
    per, by = {}, {}
    for p in pieces:
        per.setdefault(p.doc_id, []).append(p)
        by.setdefault(p.sequence_id, []).append(p)
        own = ids[p.doc_id][p.start : p.start + p.length]
        assert p.length == len(own) > 0
        assert p.doc_tokens == len(ids[p.doc_id])
        assert bytes(p.ids) == np.array(own, "<u4").tobytes()
    for d, ps in per.items():
        covered = np.zeros(len(ids[d]), int)
        for p in ps:
            covered[p.start : p.start + p.length] += 1
        assert (covered == copies[d]).all()
    assert set(per) == set(ids)
    padding = 0
    for ps in by.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 4096
        padding += 0 if at & (at - 1) == 0 else 4096 - at
    return padding


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary_path())


def test_awkward(spark, tokenizer):
    rows = [*AWKWARD, (60, "á é\ńb ΑΣ ΣΑΣ. İI"), (61, "x<|startoftext|>y <|endoftext|>"), (62, "tab\tcr\rff\x0cvt\x0b\x1c 　z\x85w")]
    pieces = packing.pack(documents(spark, rows).coalesce(1), vocabulary_path()).collect()
    check(pieces, rows, tokenizer)
    digests = packing.piece_digests(packing.pack(documents(spark, rows).coalesce(1), vocabulary_path())).collect()
    assert sorted(d.ids_crc32 for d in digests) == sorted(zlib.crc32(bytes(p.ids)) for p in pieces)
    assert packing.pack(documents(spark, []), vocabulary_path()).count() == 0


def test_real_documents(spark, data, tokenizer):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    pieces = packing.pack(docs, vocabulary_path()).collect()
    assert check(pieces, [(r.doc_id, r.text) for r in docs.collect()], tokenizer) == 0


def test_level_choice_minimises_squares():
    rng = np.random.default_rng(3)
    done = []
    packer = packing.SumOfSquares(done.append, size=50, max_open=10**9)
    for n in range(400):
        s = int(rng.integers(1, 50))
        totals = {}
        for g in [0, *np.flatnonzero(packer.level)]:
            if g + s <= 50:
                level = packer.level.copy()
                level[g] -= g > 0
                level[g + s] += g + s < 50
                totals[int(g)] = int((level[:50] ** 2).sum())
        best = min(totals.values())
        assert packer.choose(s) == max(g for g, v in totals.items() if v == best)
        packer.add(n, np.arange(s))
        assert packer.open == packer.level.sum() == sum(map(len, packer.windows.values()))
    packer.settle()
    assert packer.open <= 1


def test_many_open_windows_are_settled():
    done = []
    packer = packing.SumOfSquares(done.append, size=100, max_open=8)
    for n in range(300):
        packer.add(n, np.full(60, n))
    packer.finish()
    assert packer.open == 0
    lengths = [sum(len(x[2]) for x in w) for w in done]
    assert sum(lengths) == 300 * 60
    assert sum(x != 100 for x in lengths) <= 7


def test_pieces_as_the_tokenizer_itself(tokenizer, monkeypatch):
    import random

    monkeypatch.setattr(packing, "MAX_CACHED", 50)
    rng = random.Random(4)
    signs = [chr(c) for c in packing.PLAIN] + list("'’<|>éÉß×÷ªµº²½İΣ́\x1c\x85\u3000") + ["'re", "'LL ", "<|endoftext|>", "the ", "Thing"]
    texts = ["".join(rng.choices(signs, k=rng.randrange(1, 60))) for _ in range(1500)]
    texts += ["".join(rng.choices([chr(c) for c in packing.PLAIN], k=200)) for _ in range(300)]
    own = packing.PieceEncoder(vocabulary_path())
    for at in range(0, len(texts), 50):
        for t, ids in zip(texts[at : at + 50], own.encode(texts[at : at + 50]), strict=True):
            assert ids.tolist() == [*tokenizer.encode(t, add_special_tokens=False).ids, 2], repr(t)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_are_the_tokenizer_s_for_any_vocabulary(name):
    from tokenizers import Tokenizer

    path = vocabulary_path(name)
    rng, plain = np.random.default_rng(4), Tokenizer.from_file(path)
    letters = list("abcdeXYZ 019  \n\t'.,;!-_ßéÑüЖ你ǅ½٣  \x1c👍🏽")
    texts = ["", *("".join(rng.choice(letters, rng.integers(1, 60))) for _ in range(500)), "it's We'LL <|endoftext|> x"]
    own = packing.PieceEncoder(path)
    assert [list(x) for x in own.encode(texts)] == [[*e.ids, 2] for e in plain.encode_batch(texts, add_special_tokens=False)]
