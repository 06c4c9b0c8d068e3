"""Operator 13 against the libraries' own encoders and a plain merge of their ends."""

import random
from collections import Counter

import numpy as np
import pytest

from quire.llm import alignment as al
from quire.llm.queries import tokenizer_path
from tests.llm.common import clash, documents, edge_texts, rows, sha

A, B = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def encoders():
    import sentencepiece
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(A)
    t.encode_special_tokens = True
    return t, sentencepiece.SentencePieceProcessor(model_file=B)


def plain(texts, encoders):
    """Tokens of the libraries, groups by set intersection, counts in a Counter."""
    t, sp = encoders
    back = al._byte_characters()
    a_text = {i: bytes(back[c] for c in s) for s, i in t.get_vocab().items() if i < 50256}
    out, pairs = [], Counter()
    for text in texts:
        a = t.encode(" " + text, add_special_tokens=False).ids if text else []
        b = sp.encode(text) if text else []
        a_bytes = [a_text[i] for i in a]
        b_bytes = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode()
                   for i in b]
        whole = (" " + text).encode() if text else b""
        if b"".join(a_bytes) != whole or b"".join(b_bytes) != whole:
            a, b, a_bytes, b_bytes = [], [], [], []
        a_ends, b_ends = np.cumsum([len(x) for x in a_bytes]).tolist(), np.cumsum([len(x) for x in b_bytes]).tolist()
        groups, links, i, j = [], [], 0, 0
        for end in sorted(set(a_ends) & set(b_ends)):
            i2, j2 = a_ends.index(end, i) + 1, b_ends.index(end, j) + 1
            groups.append(",".join(map(str, a[i:i2])) + "|" + ",".join(map(str, b[j:j2])))
            links.append((a[i2 - 1], b[j2 - 1]))
            i, j = i2, j2
        pairs.update(links)
        out.append((len(a), len(b), ";".join(groups), links))
    most = Counter()
    for (_, y), n in pairs.items():
        most[y] = max(most[y], n)
    return [(n_a, n_b, len(links), len(links), sum(pairs[p] == most[p[1]] for p in links), sum(pairs[p] for p in links),
             sha(g) if n_a else "", g) for n_a, n_b, g, links in out]


TEXTS = [*edge_texts(), "a <|endoftext|> b <s> </s> <0x41>", "don't we'LL  \t\n  x", "naïve café 漢字かな 🙂🙂 ١٢٣", "mark ▁ inside",
         "12345678901234567890", " nbsp em", "é combining", "﻿bom", "same words here again and again " * 30]


@pytest.mark.parametrize("frequent", [al.FREQUENT, 5])
def test_against_plain_version(spark, encoders, frequent):
    got = rows(al.align_tokens(documents(spark, TEXTS), A, B, groups=True, frequent=frequent))
    want = plain(TEXTS, encoders)
    assert [tuple(r[c] for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "groups"))
            for r in got] == want


def test_given_documents(spark, encoders):
    from quire.llm.queries import op13_align_tokens
    got = rows(op13_align_tokens(spark, "/root/testdata/sf0.001"))
    given = sorted((r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect())
    want = plain([t for _, t in given], encoders)
    assert [(r["doc_id"], r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], r["groups_sha256"])
            for r in got] == [(d, *w[:7]) for (d, _), w in zip(given, want)]


def test_every_character(encoders):
    """The merge ranks give the ids of the JSON file for all of Unicode."""
    t, _ = encoders
    encode = al.ByteLevel(A).encoder()
    letters = [chr(c) for c in range(0x30000) if not 0xD800 <= c < 0xE000]
    random.Random(3).shuffle(letters)
    for at in range(0, len(letters), 500):
        text = " ".join("".join(letters[i:i + 5]) for i in range(at, at + 500, 5))
        assert encode(text) == t.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("piece", [1, 2, 3, 7, 256])
def test_merge_path(piece):
    r = np.random.default_rng(piece)
    for _ in range(60):
        a = np.unique(r.integers(1, 60, r.integers(0, 40)))
        b = np.unique(r.integers(1, 60, r.integers(0, 40)))
        i, j = al.common_ends(a, b, piece)
        both, at_a, at_b = np.intersect1d(a, b, return_indices=True)
        assert i.tolist() == at_a.tolist() and j.tolist() == at_b.tolist()


def test_pieces_are_of_equal_work():
    a, b = np.arange(1, 100_001), np.array([99_999, 100_000])
    cuts = np.arange(0, 100_002, 256)
    in_a = al.crossings(a, b, cuts)
    assert (np.diff(in_a) + np.diff(cuts - in_a) == 256).all()


def test_rows_of_all_kinds(spark):
    d = documents(spark, ["one two", "one two", None])
    same = clash(d).unionByName(clash(d)).select("*")
    got = rows(al.align_tokens(same, A, B))
    assert len(got) == 6 and got[0] == got[1]
    assert got[0]["count_sum"] == 4 * got[0]["n_links"] and got[-1]["groups_sha256"] == ""
    assert al.align_tokens(d.limit(0), A, B).collect() == []
    null_id = documents(spark, ["a b"]).selectExpr("cast(null as long) as doc_id", "text")
    assert al.align_tokens(null_id, A, B).first()["n_a"] == 2
