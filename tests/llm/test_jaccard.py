import random

from quire.llm import jaccard as J
from quire.llm.components import components
from tests.llm.common import SPACE, UP, clash, documents, edge_texts, rows


def brute(texts, k=4, pct=85):
    sets = []
    for t in texts:
        w = SPACE.findall((t or "").translate(UP))
        sets.append({tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    up = list(range(len(texts)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= pct * len(a | b):
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    return [(len(s), root(i)) for i, s in enumerate(sets)]


def near_copies(rng, n, words, changes):
    base = [f"b{rng.randrange(10**6)}" for _ in range(words)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(changes + 1)):
            at = rng.randrange(len(w))
            w[at:at + 1] = [] if rng.random() < 0.3 else [f"c{rng.randrange(10**6)}"]
        out.append(" ".join(w))
    return out


def test_matches_brute_force(spark):
    rng = random.Random(5)
    texts = edge_texts()
    for words in (6, 9, 20, 60, 150):
        texts += near_copies(rng, 25, words, 4)
    texts += [" ".join(rng.choice("abcdefg") for _ in range(rng.randrange(1, 30))) for _ in range(60)]
    texts += [t.upper() for t in texts[20:30]]
    got = rows(J.ngram_jaccard(clash(documents(spark, texts))))
    assert [(r["n_shingles"], r["component_id"]) for r in got] == brute(texts)


def test_chain_links_through_middle(spark):
    w = [f"w{i}" for i in range(200)]
    texts = [" ".join(w[s:s + 150]) for s in (0, 10, 20, 30, 40, 50)]
    assert [(r["n_shingles"], r["component_id"]) for r in rows(J.ngram_jaccard(documents(spark, texts)))] == brute(texts)


def test_empty_table_and_null_ids(spark):
    assert J.ngram_jaccard(documents(spark, [])).count() == 0
    df = spark.createDataFrame([(None, "a b c d e"), (3, "a b c d e"), (None, None)], "doc_id long, text string")
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in J.ngram_jaccard(df).collect()}
    assert got == {(None, 2, 3), (3, 2, 3), (None, 0, None)}


def test_keep_one(spark):
    texts = ["x y z " * 20, "x y z " * 20, None, "", "other words that stand alone in this text"]
    df = clash(documents(spark, texts))
    kept = rows(J.keep_one(df.unionByName(df.where("doc_id = 4"))))
    assert [r["doc_id"] for r in kept] == [0, 2, 3, 4]


def test_components_star_and_path(spark):
    edges = [(i, 0) for i in range(1, 50)] + [(100 + i, 101 + i) for i in range(40)] + [(7, 7)]
    got = {r.v: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(50)} | {100 + i: 100 for i in range(41)}
