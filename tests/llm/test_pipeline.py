"""The whole pipeline against a plain version of its five stages, and its stages' contracts."""

import random
import re

import pytest

import corpus_pipeline as P
from tests.llm.common import SCHEMA, clash, documents, edge_texts, rows, sha
from tests.llm.test_decontaminate import brute as contaminated
from tests.llm.test_jaccard import brute as linked, near_copies
from tests.llm.test_quality import brute as measured

sentencepiece = pytest.importorskip("sentencepiece")


def texts_and_items():
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(3000)}"
    texts = edge_texts() + [" ".join(word() for _ in range(rng.randrange(20, 150))) for _ in range(50)]
    texts += near_copies(rng, 12, 120, 3) + [texts[20], texts[21]]
    item = " ".join(word() for _ in range(25))
    texts += [f"{texts[30]} {item[:len(item) // 2]} {item} end", texts[31] + " password=" + "k9" * 10 + " end of it"]
    return texts, [(1, item), (2, None)]


def plain(texts, items):
    keep = []
    for i, t in enumerate(texts):
        m = measured(t)
        if m["n_words"] >= 50 and not (m["n_repeat_words"] is not None and 100 * m["n_repeat_words"] > 50 * m["n_words"]):
            keep.append(i)
    groups = linked([texts[i] for i in keep], 5, 80)
    keep = [i for j, i in enumerate(keep) if groups[j][1] == j]
    hit = contaminated([texts[i] for i in keep], items)
    keep = [i for i, h in zip(keep, hit) if not h[4]]
    return {i: re.sub(r"password=[A-Za-z0-9]{12,}", "<SECRET>", texts[i]) for i in keep}


def write(spark, tmp_path, texts, items):
    documents(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_run_matches_plain_version(spark, tmp_path):
    import numpy as np
    from quire.llm.queries import tokenizer_path
    texts, items = texts_and_items()
    got = rows(P.run(spark, write(spark, tmp_path, texts, items)))
    want = plain(texts, items)
    assert [r["doc_id"] for r in got] == sorted(want)
    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path())
    for r in got:
        ids = sp.encode(want[r["doc_id"]], add_bos=True, add_eos=True)
        assert r["ids_sha256"] == sha(np.array(ids, "<u4").tobytes()) and r["n_tokens"] == len(ids)


def test_stages_keep_columns_and_take_empty_tables(spark, tmp_path):
    sf = write(spark, tmp_path, ["a b c"], [(1, "x y z")])
    for empty in (documents(spark, []), clash(documents(spark, []))):
        for _, stage in P.STAGES[:-1]:
            out = stage(spark, empty, sf)
            assert out.columns == empty.columns and out.count() == 0
    assert P.STAGES[-1][1](spark, documents(spark, []), sf).count() == 0
    assert [n for n, _ in P.STAGES][0] == "quality rules" and len(P.STAGES) == 5 and SCHEMA.startswith("doc_id")
