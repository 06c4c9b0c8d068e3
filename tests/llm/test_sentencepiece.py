import random

import pytest

from quire.llm import sentencepiece_bpe as S
from quire.llm.queries import tokenizer_path
from tests.llm.common import clash, documents, edge_texts, rows, sha

sentencepiece = pytest.importorskip("sentencepiece")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=tokenizer_path())


@pytest.fixture(scope="module")
def coder():
    return S.Coder(S.Model(tokenizer_path()))


def test_random_texts_and_piece_runs(library, coder):
    rng = random.Random(1)
    letters = "abcdefgh 123.,;:'\"()[]{}<>/*-_=+\n\t\r\x0b\x0c éèüßñ日本語\U0001F600▁\x00   THEing"
    pieces = list(coder.model.ids)
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(4000)]
    texts += ["".join(rng.choice(pieces) for _ in range(rng.randrange(9))).replace("▁", " ") for _ in range(4000)]
    texts += [t or "" for t in edge_texts()]
    for t in texts:
        ids = library.encode(t)
        assert coder.encode(t) == ids, t[:80]
        assert coder.decode([1, *ids, 2]) == library.decode([1, *ids, 2])


def test_decode_of_any_ids(library, coder):
    rng = random.Random(2)
    for _ in range(500):
        ids = [rng.choice((1, 2, 28705, rng.randrange(3, 32000), 259, 264)) for _ in range(rng.randrange(6))]
        valid = bytes(b"".join(coder.model.text[i] for i in ids))
        try:
            valid.decode()
        except UnicodeDecodeError:
            continue
        assert coder.decode(ids) == library.decode(ids), ids


def test_query_digests(spark, library):
    import numpy as np
    texts = edge_texts()
    got = rows(S.sentencepiece_tokens(clash(documents(spark, texts)), tokenizer_path()))
    for r, t in zip(got, texts, strict=True):
        ids = library.encode(t or "", add_bos=True, add_eos=True)
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == sha(np.array(ids, "<u4").tobytes())
        assert r["decoded_sha256"] == sha(library.decode(ids))
    assert S.sentencepiece_tokens(documents(spark, []), tokenizer_path()).count() == 0


def test_memory_is_bounded(monkeypatch, library):
    monkeypatch.setattr(S, "REMEMBER", 10)
    monkeypatch.setattr(S, "REMEMBER_PAIRS", 10)
    c = S.Coder(S.Model(tokenizer_path()))
    for i in range(50):
        t = f"some words number {i} and so on {i * 7919}"
        assert c.encode(t) == library.encode(t)
    assert len(c.memory) <= 10 and len(c.fits) <= 10
