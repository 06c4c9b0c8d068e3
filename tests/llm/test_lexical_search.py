"""Operator 11 against a plain ranking of all documents."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from quire.llm import lexical_search as ls
from tests.llm.common import clash, documents, edge_texts

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UP = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return [t.translate(UP) for t in TERM.findall(text or "")]


def plain(docs, items, top=10):
    """[(item_id, rank, doc_id, score)] from lists of (id, text)."""
    bags = [(d, Counter(terms(t))) for d, t in docs]
    bags = [(d, b, sum(b.values())) for d, b in bags if b]
    n_docs, n_terms = len(bags), sum(n for _, _, n in bags)
    df = Counter(t for _, b, _ in bags for t in b)
    out = []
    for item, text in items:
        scored = []
        for d, b, n in bags:
            m = 25 + (75 * n * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * b[t]) // (1000 * b[t] + 8 * m))
                    for t in terms(text))
            if s > 0:
                scored.append((-s, d is None, d or 0, d))
        out += [(item, i + 1, d, -s) for i, (s, _, _, d) in enumerate(sorted(scored)[:top])]
    return out


def table(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


def found(df):
    got = [(r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect()]
    return sorted(got, key=lambda r: (r[0] is None, r[0] or 0, r[1]))


ITEMS = [(1, "same words here AGAIN"), (2, "w5x3 w9 w10x2, one! one"), (3, None), (4, ""), (5, "absent term"), (6, "b a Ünï"),
         (7, "zzz " + "z" * 60000), (8, "again and again and again")]


@pytest.mark.parametrize("batch_terms", [ls.BATCH_TERMS, 3])
def test_against_plain_ranking(spark, batch_terms):
    texts = [*edge_texts(), *(f"again and {'word ' * i} again {'and ' * (i % 7)}" for i in range(40))]
    got = found(ls.ranked_search(clash(documents(spark, texts)), clash(table(spark, ITEMS).withColumnRenamed("text", "asked")),
                                 item_text="asked", batch_terms=batch_terms))
    assert got == plain(list(enumerate(texts)), ITEMS)


def test_given_tables(spark):
    from quire.llm.queries import op11_ranked_search
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = sorted((r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect())
    assert found(op11_ranked_search(spark, sf)) == plain(docs, items)


def test_copies_ties_and_null_ids(spark):
    """A third of all rows are one text; only the smallest ids are left to be scored."""
    rows = [(i, "common passage of some words") for i in range(300)] + [(1000 + i, f"other passage {i}") for i in range(600)]
    rows += [(None, "common passage of some words"), (5, "common passage of some words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    items = [(1, "passage of words"), (1, "passage of words"), (2, "other")]
    got = found(ls.ranked_search(docs, table(spark, items)))
    want = plain(rows, items)
    assert sorted(got) == sorted(want)
    assert [r[2] for r in got if r[0] == 1][:14:2] == [0, 1, 2, 3, 4, 5, 5]
    nulls = [(None, "a b"), (None, "a c"), (3, "a b")]
    got = ls.ranked_search(spark.createDataFrame(nulls, "doc_id long, text string"), table(spark, [(9, "b"), (8, "a")]))
    assert found(got) == sorted(plain(nulls, [(9, "b"), (8, "a")]))


def test_few_documents_pass_the_bounds(spark):
    """The second pass leaves about the result, not the corpus, to be scored."""
    r = np.random.default_rng(5)
    vocabulary = np.array([f"w{i}" for i in range(3000)])
    p = 1 / np.arange(1, 3001)
    texts = [" ".join(r.choice(vocabulary, int(r.integers(20, 400)), p=p / p.sum())) for _ in range(2000)]
    docs, items = documents(spark, texts), table(spark, [(i, texts[i * 31][:200]) for i in range(30)])
    index = ls.signature_index(docs)
    asked = [(i, texts[i * 31][:200]) for i in range(30)]
    assert found(ls.ranked_search(index, items)) == plain(list(enumerate(texts)), asked)
    scored = []
    kept, ls._score = ls._score, lambda i, f, it: (scored.append(f.count()), kept(i, f, it))[1]
    try:
        ls.ranked_search(index, items).collect()
    finally:
        ls._score = kept
    print(scored)
    assert scored[1] < 30 * 40


def test_bounds_are_never_below_scores(spark):
    r = np.random.default_rng(6)
    texts = [" ".join(f"t{int(x)}" for x in r.zipf(1.5, int(r.integers(1, 300))) % 50) for _ in range(200)]
    index = ls.signature_index(documents(spark, texts))
    told, _ = ls._batch(index, spark.createDataFrame([(0, f"t{i}") for i in range(30)], "item long, text string").mapInArrow(
        ls.item_terms, "item long, term long, times long"))
    exact = {d: s for _, _, d, s in plain(list(enumerate(texts)), [(0, " ".join(f"t{i}" for i in range(30)))], top=1000)}
    seen = 0
    for row in index.blocks.collect():
        row = row.asDict()
        for lo, bound in ls.bounds(row, told, (index.n_docs, index.n_terms)):
            for d, b in zip(row["docs"][lo:], bound[0]):
                assert b >= exact.get(d, 0)
                seen += 1
    assert seen == index.n_docs == len([t for t in texts if t])


def test_empty_tables(spark):
    docs, items = documents(spark, ["a b"]), table(spark, [(1, "a")])
    assert found(ls.ranked_search(docs, items)) != []
    assert found(ls.ranked_search(docs.limit(0), items)) == [] == found(ls.ranked_search(docs, items.limit(0)))
    assert found(ls.ranked_search(documents(spark, [None, "", "!!"]), items)) == []
