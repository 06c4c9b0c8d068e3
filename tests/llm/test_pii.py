import random
import re

from pyspark.sql import functions as F

from quire.llm import pii as P
from tests.llm.common import clash, documents, edge_texts, rows, sha


def brute(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(x) <= 255 for x in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m.group())
        if 12 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def test_base_matches_brute_force(spark):
    rng = random.Random(3)
    letters = "a.b@c-d_%+e 0123456789 ()..--é\U0001F600\n+@"
    texts = edge_texts() + ["".join(rng.choice(letters) for _ in range(rng.randrange(120))) for _ in range(1500)]
    texts += ["4111 1111-1111 1111", "a@b.cd_e@f.gh x@a@b.c", "1.2.3.4.5.6.7.8", "0001.2.3.04 9999999999.1.1.1",
              "1" * 50000, "a" * 50000 + "@b.c", "a@b.cc " * 2000, "+1 (555) 123-4567 +12"]
    got = rows(P.pii_scan(clash(documents(spark, texts))))
    for r, t in zip(got, texts, strict=True):
        want = brute(t or "")
        base = ",".join(f"{P.KINDS[k]}:{a}:{b}" for a, k, b in want)
        assert [r[f"n_{P.KINDS[k]}"] for k in range(4)] == [sum(x[1] == k for x in want) for k in range(4)], t[:200]
        assert r["base_sha256"] == sha(base)
        assert ",".join(x for x in r["spans"].split(",") if not x.startswith("other")) == base


def test_trees_add_spans_and_leave_numbers(spark):
    rng = random.Random(9)
    n = lambda k: "".join(rng.choice("23456789") for _ in range(k))
    texts = [f"call +1 ({n(3)}) {n(3)}-{n(4)} now" for _ in range(300)]
    texts += [f"on 20{n(2)}-1{rng.randrange(3)}-{n(2)[:1]} it cost {n(16)} units" for _ in range(300)]
    texts += ["call (312) 555-7788 now", "nothing here", "in 2024-11-05 again"]
    got = rows(P.pii_scan(documents(spark, texts)))[-3:]
    assert got[0]["spans"] == "other:5:19"
    assert got[1]["spans"] == got[2]["spans"] == ""


def test_empty_table_and_no_python(spark):
    assert P.pii_scan(documents(spark, [])).count() == 0
    plan = P.pii_scan(documents(spark, ["a"]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def found(spark, text):
    body = F.lit(text)
    cands = spark.range(1).select(F.explode(P.candidates(body, P.base_spans(body))).alias("c")).select("c.*").collect()
    assert all(text[c.start:c.end] == c.body for c in cands)
    return {c.body: c.label for c in cands}


def test_candidates_of_all_types_may_overlap(spark):
    for text, alone in (("2024-01-15 312-555-7788", "312-555-7788"), ("on 2024-01-15 078-05-1120.", "078-05-1120"),
                        ("312 555 7788 4111 1111 1111 1111", "312 555 7788"), ("é DE89 3704 0044 0532 0130 00 é",) * 2,
                        ("+49 30 1234 5678 312-555-7788", "312-555-7788")):
        alone = alone.strip("é ")
        assert alone in found(spark, text), text
    assert found(spark, "2024-01-15 312-555-7788")["312-555-7788"] == -1
    assert found(spark, "312 555 7788 4111 1111 1111 1111")["4111 1111 1111 1111"] == -1
    part = found(spark, "card 4111 1111 1111 1111 312")       # the base card ends within this candidate or there is none
    assert part["4111 1111 1111 1111"] != 0
    assert found(spark, "aa:bb:cc:dd:ee:ff 11:22:33:44:55:66:77:88").keys() >= {"aa:bb:cc:dd:ee:ff", "11:22:33:44:55:66:77:88"}


def test_overlapping_spans_are_resolved_after_scoring(spark):
    rng = random.Random(9)
    n = lambda k: "".join(rng.choice("23456789") for _ in range(k))
    texts = [f"call +1 ({n(3)}) {n(3)}-{n(4)} now" for _ in range(300)] + [f"call +1 {n(3)}-{n(3)}-{n(4)} now" for _ in range(300)]
    texts += [f"on 20{n(2)}-1{rng.randrange(3)}-{n(2)[:1]} it cost {n(16)} units" for _ in range(300)]
    texts += ["call 2024-01-15 312-555-7788 now", "call 312-555-7788 now"]
    got = rows(P.pii_scan(documents(spark, texts)))[-2:]
    assert [r["spans"] for r in got] == ["other:16:28", "other:5:17"]


def test_apart(spark):
    array = "array(" + ",".join(f"named_struct('rank',{r},'less',{s}d,'shorter',{a - b},'start',{a},'end',{b})" for r, s, a, b in (
        (2, -9, 0, 20), (1, -3, 5, 12), (1, -4, 10, 15), (2, -1, 15, 18), (1, -1, 30, 40))) + ")"
    got = spark.range(1).select(P.apart(F.expr(array)).alias("x")).first().x
    assert sorted((r.start, r.end) for r in got) == [(10, 15), (15, 18), (30, 40)]


def test_all_labelled_candidates_are_learnt_from(spark):
    texts = [f"born 19{i % 100:02d}-{i % 12 + 1:02d}-{i % 28 + 1:02d} no {i} and {10 ** 14 + i * 7919} units" for i in range(4000)]
    docs = documents(spark, texts + texts[:500])        # copies of a candidate and what is around it count once
    body = F.col("text")
    found = docs.select(P.candidates(body, P.base_spans(body)).alias("cands")).cache()
    labelled = {(c.label, c.body, c.left, c.right) for r in found.collect() for c in r.cands if c.label in (0, 1)}
    assert sum(c[0] == 0 for c in labelled) > 7000
    got = P.tallies(found).collect()
    assert [sum(r.n for r in got if r.label == y) for y in (0, 1)] == [sum(c[0] == y for c in labelled) for y in (0, 1)]
    assert len(got) < 100


def test_counted_vectors_give_the_trees_of_single_examples():
    import numpy as np
    from quire.llm import boosting
    rng = np.random.default_rng(5)
    x, w = rng.integers(0, 9, (200, 4)).astype(float), rng.integers(1, 6, 200).astype(float)
    y = (x[:, 0] + x[:, 1] > 8).astype(float)
    many = np.repeat(np.arange(200), w.astype(int))
    one = np.ones(len(many))
    a, b = boosting.train(x, y, w), boosting.train(x[many], y[many], one)
    assert np.allclose(boosting.log_odds(a, x), boosting.log_odds(b, x))
    assert np.isclose(boosting.threshold(a, x, y, w, 0.9), boosting.threshold(b, x[many], y[many], one, 0.9))
