import random

from quire.llm import decontaminate as D
from tests.llm.common import ALNUM, UP, clash, documents, edge_texts, rows, sha

WORDS = "the of and to in a is that it was for on are as with his they be at one have this from or had by hot but".split()


def brute(texts, items, width=10):
    low = lambda t: ALNUM.findall((t or "").translate(UP))
    its = {i: low(t) for i, t in items}
    wins = {}
    for i, w in its.items():
        k = min(width, len(w))
        for j in range(len(w) - k + 1 if w else 0):
            wins.setdefault(tuple(w[j:j + k]), set()).add(i)
    out = []
    for t in texts:
        w, hit, ids = low(t), set(), set()
        for k in {len(x) for x in wins}:
            for j in range(len(w) - k + 1):
                if (x := tuple(w[j:j + k])) in wins:
                    hit |= set(range(j, j + k))
                    ids |= wins[x]
        out.append((len(w), len(hit), len(ids), sha(",".join(sorted(map(str, ids)))), bool(hit)))
    return out


def cases():
    rng = random.Random(8)
    items = [(i, " ".join(rng.choice(WORDS) for _ in range(rng.choice((1, 2, 3, 5, 9, 10, 11, 40))))) for i in range(40)]
    items += [(40, None), (41, ""), (42, "..."), (43, items[3][1]), (44, "Ünï côdé Words stay")]
    texts = edge_texts() + [" ".join(rng.choice(WORDS) for _ in range(rng.randrange(120))) for _ in range(80)]
    for i in (3, 6, 7, 9):
        texts.append("before, " + items[i][1].upper().replace(" ", " -- ") + ". After " + items[i][1])
    return items, texts + ["ünï côdé words stay"]


def test_matches_brute_force(spark):
    items, texts = cases()
    df = clash(documents(spark, texts))
    bench = clash(spark.createDataFrame(items, "item_id long, text string"))
    got = rows(D.decontaminate(df, bench))
    assert [(r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in got] == brute(texts, items)
    kept = rows(D.drop_contaminated(df, bench))
    assert [r["doc_id"] for r in kept] == [r["doc_id"] for r in got if not r["contaminated"]]


def test_shuffled_item_side_gives_the_same(spark, monkeypatch):
    items, texts = cases()
    bench = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(D, "BROADCAST_ROWS", 0)
    got = rows(D.decontaminate(documents(spark, texts), bench))
    assert [(r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in got] == brute(texts, items)


def test_empty_sides_and_repeated_rows(spark):
    items, texts = cases()
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert D.decontaminate(documents(spark, []), bench).count() == 0
    got = rows(D.decontaminate(documents(spark, texts[:3]), bench.limit(0)))
    assert all(not r["contaminated"] and r["items_sha256"] == sha("") for r in got)
    df = documents(spark, [texts[-2]])
    twice = rows(D.decontaminate(df.unionByName(df), bench))
    assert len(twice) == 2 and twice[0] == twice[1] and twice[0]["n_hit"] == brute([texts[-2]], items)[0][1]
