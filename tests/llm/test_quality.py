from quire.llm import quality as Q
from tests.llm.common import SPACE, clash, documents, edge_texts, rows


def brute(t):
    t = t or ""
    w = SPACE.findall(t)
    lines = [x for x in t.split("\n") if SPACE.search(x)]
    tri = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    hit = {p for i, x in enumerate(tri) if tri.count(x) > 1 for p in (i, i + 1, i + 2)} if len(tri) < 3000 else None
    return {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(c in "#*$%&|<>" for c in t),
            "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(hit) if hit is not None else None}


def test_measures_match_brute_force(spark):
    texts = edge_texts() + ["a b c a b c d a b", "x x x x x", "#a $b\n#a $b\n \n", "a b c d a b c", "a b a b a b a"]
    got = rows(Q.quality(clash(documents(spark, texts))))
    for r, t in zip(got, texts, strict=True):
        for k, v in brute(t).items():
            assert v is None or r[k] == v, (k, t[:40] if t else t)
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])


def test_bad_host_loses_strict_failures_only(spark):
    good = " ".join(f"word{i}" for i in range(80))
    marked = " ".join(f"word{i}$$" for i in range(80))
    texts = ["short"] * 30 + [good, marked] + [good + f" {i}" for i in range(30)] + [marked]
    src = ["bad"] * 32 + ["fine"] * 31
    got = rows(Q.quality(documents(spark, texts, sources=src)))
    assert [r["kept"] for r in got[30:32]] == [True, False]     # the bad host's clean one stays
    assert got[-1]["kept"] and not got[-1]["host_bad"]
    kept = rows(Q.keep_good(clash(documents(spark, texts, sources=src))))
    assert [r["doc_id"] for r in kept] == [r["doc_id"] for r in got if r["kept"]]
    assert "host" in kept[0] and kept[0]["host"] == "x"


def test_shrinkage(spark):
    df = spark.createDataFrame([("a", i < 1) for i in range(1)] + [("b", i < 90) for i in range(100)]
                               + [("c", i < 2) for i in range(100)], "host string, base_failed boolean")
    got = {r.host: r for r in Q.host_verdicts(df).collect()}
    assert got["a"].host_rate < 1 and 0.5 < got["b"].host_rate < 0.9 and got["c"].host_rate > 0.02
    assert got["b"].host_bad and not got["c"].host_bad


def test_empty_and_null_host(spark):
    assert Q.quality(documents(spark, [])).count() == 0
    assert Q.keep_good(documents(spark, [])).count() == 0
    got = rows(Q.quality(documents(spark, ["a", "b"], sources=[None, None])))
    assert [r["host_bad"] for r in got] == [False, False]


def test_plan_has_no_python(spark):
    p = Q.keep_good(documents(spark, ["a"]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in p and "Arrow" not in p
