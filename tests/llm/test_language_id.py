"""Operator 12: automata and phrases against plain search, held-out accuracy."""

import zlib

import numpy as np
import pytest

from quire.llm import language_id as li
from quire.llm.queries import op12_language_id
from tests.llm.common import clash, documents, edge_texts, rows


def plain_phrases(sample: bytes, text: bytes) -> int:
    """Greedy longest matches by substring search, segment by segment."""
    n = 0
    for lo in range(0, len(text), li.SEGMENT):
        part, at = text[lo:lo + li.SEGMENT], 0
        while at < len(part):
            stop = at + 1
            while stop < len(part) and part[at:stop + 1] in sample:
                stop += 1
            n, at = n + 1, stop
    return n


def automaton(lang, sample):
    a, b, c, states = li.suffix_automaton(sample)
    return li.Automaton(lang, len(sample), states, np.array(a, np.int64), np.array(b, np.uint8), np.array(c, np.int64))


def test_phrases_against_search():
    r = np.random.default_rng(1)
    samples = [bytes(r.integers(97, 97 + k, 300).astype(np.uint8)) for k in (2, 3, 5)]
    texts = [bytes(r.integers(97, 97 + 6, n).astype(np.uint8)) for n in (0, 1, 5, 511, 512, 513, 2000)]
    parser = li.Parser([automaton(str(i), s) for i, s in enumerate(samples)])
    data = np.frombuffer(b"".join(texts), np.uint8)
    got = parser.phrases(data, np.append(0, np.cumsum([len(t) for t in texts])))
    assert got.tolist() == [[plain_phrases(s, t) for t in texts] for s in samples]


def test_automaton_accepts_exactly_the_substrings():
    sample = b"abcbcabcbbca"
    a, b, c, states = li.suffix_automaton(sample)
    go = {(x, y): z for x, y, z in zip(a, b, c)}
    assert states <= 2 * len(sample) and len(a) <= 3 * len(sample)

    def accepts(word):
        s = 0
        for x in word:
            s = go.get((s, x))
            if s is None:
                return False
        return True

    from itertools import product
    for n in range(1, 6):
        for word in product(b"abc", repeat=n):
            assert accepts(word) == (bytes(word) in sample)


def test_fold():
    texts = ["  Ab--c 12", "", "é!É", "..."]
    raw = [t.encode() for t in texts]
    data, at = li.fold(np.frombuffer(b"".join(raw), np.uint8), np.append(0, np.cumsum([len(x) for x in raw])))
    assert [data[i:j].tobytes().decode() for i, j in zip(at, at[1:])] == ["ab c ", "", "é É", ""]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_held_out_accuracy(spark, sf):
    """Labels of held-out documents are found; changing them changes no prediction."""
    d = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    truth = {r.doc_id: r.lang for r in d.select("doc_id", "lang").collect()}
    got = rows(op12_language_id(spark, f"/root/testdata/{sf}"))
    assert len(got) == len(truth)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    held = [r for r in got if r["held_out"] and r["lang_pred"] != "und"]
    right = sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) / len(held)
    print(sf, len(held), right)
    assert right > 0.97
    from pyspark.sql import functions as F
    other = d.withColumn("lang", F.when(li.held_out(F.col("doc_id")), F.lit("xx")).otherwise(F.col("lang")))
    assert rows(li.identify_language(other)) == got


def test_rows_of_all_kinds(spark):
    base = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").drop("n_chars")
    french = next(r.text for r in base.orderBy("doc_id").collect() if r.lang == "fr" and len(r.text.split()) > 40)
    d = documents(spark, [*edge_texts(), "12 34 ... !", "x", " ".join(french.split()[:40]).upper()]).drop("n_chars")
    d = d.selectExpr("doc_id + 100000 as doc_id", "text", "cast(null as string) as lang", "source")
    got = {r["doc_id"] - 100000: r for r in rows(li.identify_language(clash(base.unionByName(d)))) if r["doc_id"] >= 100000}
    assert [got[i]["lang_pred"] for i in (0, 1, 2, 10)] == ["und"] * 4 and got[0]["score"] == 0
    assert got[6]["lang_pred"] == got[7]["lang_pred"] and got[6]["score"] == got[7]["score"]
    assert got[12]["lang_pred"] == "fr" and all(0 <= r["score"] <= 1 for r in got.values())
    assert li.identify_language(d.limit(0)).collect() == []
    assert {r["lang_pred"] for r in rows(li.identify_language(d))} == {"und"}          # nothing to learn from


def test_one_language_copies_and_null_id(spark):
    texts = ["a text of words"] * 50 + ["other words here"]
    d = documents(spark, texts)
    got = rows(li.identify_language(d))
    assert {(r["lang_pred"], r["score"]) for r in got} == {("en", 1.0)}
    null = d.selectExpr("cast(null as long) as doc_id", "text", "lang")
    assert {r["held_out"] for r in rows(li.identify_language(null))} == {False}
