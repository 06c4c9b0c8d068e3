import numpy as np
from pyspark.sql import functions as F

from quire.operators import retrieval as rt
from quire.plans.tables import table
from tests.conftest import SF_SMALL


def _rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_knn_grid_equals_broadcast_and_brute_force(spark):
    e = table(spark, SF_SMALL, "embeddings")
    q = e.filter(F.col("label") < 3).select("vec_id", F.col("embedding").alias("qvec"))
    a = rt.knn(q, e, 7, "vec_id", "vec_id", mode="broadcast")
    b = rt.knn(q, e, 7, "vec_id", "vec_id", mode="grid", item_blocks=5)
    assert _rows(a, "qid", "iid", "score", "rank") == _rows(b, "qid", "iid", "score", "rank")
    pe = e.toPandas()
    m = np.stack(pe["embedding"].map(np.asarray)).astype(np.float64)
    m = m / np.linalg.norm(m, axis=1, keepdims=True)
    ids = pe["vec_id"].to_numpy()
    got = {}
    for qid, iid, rank in a.select("qid", "iid", "rank").collect():
        got.setdefault(qid, {})[rank] = iid
    for qi in [i for i in range(len(ids)) if pe["label"][i] < 3][:20]:
        s = np.round(m @ m[qi], 6)
        order = sorted(range(len(ids)), key=lambda j: (-s[j], ids[j]))[:7]
        assert [got[ids[qi]][r] for r in range(1, 8)] == [ids[j] for j in order]


def test_bm25_grid_equals_broadcast(spark):
    docs = table(spark, SF_SMALL, "documents").select("doc_id", "text")
    bench = table(spark, SF_SMALL, "benchmark")
    a = rt.bm25(bench, docs, 10, "item_id", "text", "doc_id", "text", mode="broadcast")
    b = rt.bm25(bench, docs, 10, "item_id", "text", "doc_id", "text", mode="grid", item_blocks=3)
    assert _rows(a, "qid", "iid", "score", "rank") == _rows(b, "qid", "iid", "score", "rank")
    assert a.count() == bench.count() * 10
    from quire.operators.postings import build_postings
    c = rt.bm25(bench, build_postings(docs, "doc_id", "text"), 10, "item_id", "text", "doc_id", "text")
    assert _rows(a, "qid", "iid", "score", "rank") == _rows(c, "qid", "iid", "score", "rank")


def test_postings_search_equals_cells(spark):
    """Common words, ties, filters, blank questions and items, several sizes of k; one
    index for two batches."""
    from quire.operators.postings import build_postings
    rng = np.random.default_rng(3)
    words = np.array([f"w{i}" for i in range(300)])
    p = 1 / np.arange(1, 301)
    rows = [(i, " ".join(rng.choice(words, int(rng.integers(0, 60)), p=p / p.sum())), ["csv", "pdf", None][i % 3]) for i in range(600)]
    items = spark.createDataFrame(rows + [(600, None, "csv"), (601, "w0 w0 w1", "pdf"), (602, "w0 w0 w1", "pdf")],
                                  "chunk_id int, chunk_text string, source_type string")
    asked = [(i, " ".join(rng.choice(words, 8, p=p / p.sum())), [None, "csv", "pdf", "none"][i % 4]) for i in range(40)]
    asked += [(100, "", None), (101, None, None), (102, "absent", None), (103, "w0 w1", "pdf")]
    index = build_postings(items, "chunk_id", "chunk_text", "source_type", buckets=8)
    for qs, query_filter, k in ((asked, "f", 7), ([a for a in asked if a[2]], "f", 1), (asked, None, 50)):
        q = spark.createDataFrame(qs, "qid int, q string, f string")
        how = dict(query_filter=query_filter, item_type="source_type")
        a = rt.bm25(q, index, k, "qid", "q", "chunk_id", "chunk_text", **how)
        b = rt.bm25(q, items, k, "qid", "q", "chunk_id", "chunk_text", mode="broadcast", **how)
        assert _rows(a, "qid", "iid", "score", "rank") == _rows(b, "qid", "iid", "score", "rank")


def test_postings_read_only_the_batch(spark):
    """Partition filters on bucket and type; common words make no row for each item."""
    from quire.operators import postings as po
    rows = [(i, "the common words " + ("rare" if i < 30 else f"other{i % 50}"), "csv" if i % 2 else "pdf") for i in range(2000)]
    items = spark.createDataFrame(rows, "chunk_id int, chunk_text string, source_type string")
    index = po.build_postings(items, "chunk_id", "chunk_text", "source_type", buckets=32)
    q = spark.createDataFrame([(1, "the common rare words", "csv")], "qid int, q string, f string")
    _, lists = po.search_plans(index, q, "qid", "q", rt.BM25_K1, rt.BM25_B, "f")
    plan = lists._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket#" in plan.split("PartitionFilters")[1] and "type#" in plan.split("PartitionFilters")[1]
    assert "Python" not in plan and {r["_source_type"] for r in lists.select("_source_type").distinct().collect()} == {"csv"}
    made = []
    kept, po.materialize = po.materialize, lambda df, label: (made.append((label, (x := kept(df, label)).count())), x)[1]
    try:
        got = rt.bm25(q, index, 5, "qid", "q", "chunk_id", "chunk_text", query_filter="f")
        assert [r["iid"] for r in got.orderBy("rank").collect()] == [1, 3, 5, 7, 9]
    finally:
        po.materialize = kept
    assert dict(made)["candidates"] == 15


def test_source_filter_applies_per_query(spark):
    items = spark.createDataFrame([(1, "ginger tea", "csv"), (2, "ginger root", "pdf"), (3, "tea leaves", "pdf")],
                                  "chunk_id int, chunk_text string, source_type string")
    qs = spark.createDataFrame([(10, "ginger tea", "pdf"), (11, "ginger tea", None)], "qid int, q string, f string")
    for mode in ("broadcast", "grid"):
        hits = rt.bm25(qs, items, 3, "qid", "q", "chunk_id", "chunk_text", query_filter="f",
                       item_type="source_type", mode=mode, item_blocks=2)
        got = {(r["qid"], r["iid"]) for r in hits.collect()}
        assert got == {(10, 2), (10, 3), (11, 1), (11, 2), (11, 3)}, mode
    from quire.functions.vectors import HashingEncoder, embed
    enc = HashingEncoder(16)
    iv = embed(items, "chunk_text", enc)
    qv = embed(qs, "q", enc, "qvec")
    for mode in ("broadcast", "grid"):
        vh = rt.knn(qv, iv, 3, "qid", "chunk_id", query_filter="f", item_type="source_type", mode=mode,
                    item_blocks=2)
        assert {r["iid"] for r in vh.filter("qid = 10").collect()} <= {2, 3}, mode


def test_rrf(spark):
    v = spark.createDataFrame([(1, "a", 0.9, 1), (1, "b", 0.8, 2)], "qid int, iid string, score double, rank int")
    k = spark.createDataFrame([(1, "b", 5.0, 1), (1, "c", 4.0, 2)], "qid int, iid string, score double, rank int")
    out = rt.rrf([v, k], 3).orderBy("rank").select("iid").collect()
    assert [r[0] for r in out] == ["b", "a", "c"]


def test_mmr_rules(spark):
    cases = [(["a", "b"], [0.1, 0.2], 5, [0, 1]), (["", "", ""], [3.0, 2.0, 1.0], 2, [0, 1]),
             (["x y", "x y", "z w"], [0.9, 0.9, 0.5], 2, [0, 2]), (["a", "b", "c"], [None, None, 1.0], 1, [2]),
             (["a", "b", "c"], [-1.0, -3.0, -2.0], 1, [0]), ([None, "A a b", "a a B", "c"], [0.1, 0.9, 0.8, 0.2], 3, [1, 2, 3])]
    rows = [(q, i, s, i + 1, t, k) for q, (texts, scores, k, _) in enumerate(cases)
            for i, (t, s) in enumerate(zip(texts, scores))]
    cands = spark.createDataFrame(rows, "qid int, iid int, score double, rank int, chunk_text string, k int")
    got = {}
    for r in rt.mmr(cands, top_k_col="k").orderBy("qid", "mmr_rank").collect():
        got.setdefault(r["qid"], []).append(r["iid"])
    # 0.5 * 0.2/0.9 against 0.5 * 0.8/0.9 - 0.5 * cos: the unlike one comes second in the last case
    cases[-1] = (*cases[-1][:3], [1, 3, 0])
    assert got == {q: c[3] for q, c in enumerate(cases)}


def test_knn_ignores_unusable_vectors(spark):
    good = [(i, [1.0, i / 10, 0.0]) for i in range(30)]
    bad = [(100, [float("inf"), 0.0, 0.0]), (101, [float("nan")] * 3), (102, [float("-inf"), 1.0, 0.0])] + [
        (103 + i, [float("nan"), 1.0, 1.0]) for i in range(6)]
    items = spark.createDataFrame(good + bad, "vec_id int, embedding array<double>")
    q = spark.createDataFrame([(0, [1.0, 0.5, 0.1])], "qid int, qvec array<double>")
    for mode in ("broadcast", "grid"):
        hits = rt.knn(q, items, 5, "qid", "vec_id", mode=mode, item_blocks=2).collect()
        assert len(hits) == 5 and all(h["iid"] < 100 for h in hits), mode


def test_mmr_operator_keeps_subset(spark):
    rows = [(1, f"c{i}", 1.0 - i / 10, i + 1, f"text {i % 3} same") for i in range(8)]
    cands = spark.createDataFrame(rows, "qid int, iid string, score double, rank int, chunk_text string")
    out = rt.mmr(cands, 3).collect()
    assert len(out) == 3 and len({r["iid"] for r in out}) == 3
    assert sorted(r["mmr_rank"] for r in out) == [1, 2, 3]


def test_lsh_recall_and_shape(spark):
    e = table(spark, SF_SMALL, "embeddings")
    q = e.select("vec_id", F.col("embedding").alias("qvec"))
    approx = rt.knn_lsh(q, e, 5, "vec_id", "vec_id", exclude_self=True)
    exact = rt.knn(q, e, 5, "vec_id", "vec_id", exclude_self=True)
    r = rt.recall_at_k(approx, exact).first()
    assert r["n_queries"] == e.count() and r["recall"] > 0.9
    # every approximate score is the exact cosine of that pair
    bad = approx.join(exact, ["qid", "iid"]).filter(approx.score != exact.score).count()
    assert bad == 0
    wide, narrow = (rt.lsh_pairs(q, e, "vec_id", "vec_id", exclude_self=True, tables=6, probe_flips=p) for p in (True, False))
    assert narrow.join(wide, ["qid", "iid"], "left_anti").count() == 0 and narrow.count() < wide.count()


def test_lsh_bits_grow_with_the_items():
    assert [rt.lsh_bits(n, 8) for n in (0, 8, 500, 2000, 10**9)] == [1, 1, 6, 8, 27]
    assert (rt.lsh_planes(64, 2, 3) == rt.lsh_planes(64, 3, 5)[:2, :3]).all()


def test_lsh_recall_holds_as_items_grow(spark):
    import numpy as np
    rng = np.random.default_rng(4)
    v = rng.normal(size=(20000, 64)).round(4)
    e = spark.createDataFrame([(i, x) for i, x in enumerate(v.tolist())], "vec_id long, embedding array<double>").repartition(8)
    for n in (2000, 20000):
        items = e.where(F.col("vec_id") < n)
        q = items.where("vec_id < 60").select("vec_id", F.col("embedding").alias("qvec"))
        approx = rt.knn_lsh(q, items, 5, "vec_id", "vec_id", exclude_self=True)
        exact = rt.knn(q, items, 5, "vec_id", "vec_id", exclude_self=True)
        assert rt.recall_at_k(approx, exact).first()["recall"] >= 0.9


def test_lsh_shape_follows_the_collision_rate():
    import numpy as np
    for cosine in (0.3, 0.6, 0.9):
        for n in (500, 20000, 2 * 10**6, 10**9):
            tables, bits = rt.lsh_shape(np.full(10, cosine), n, 8)
            p = 1 - np.arccos(cosine) / np.pi
            assert rt.LSH_TABLES <= tables <= rt.LSH_MAX_TABLES and bits <= rt.lsh_bits(n, 8)
            assert 1 - (1 - rt.collision(p, bits, True)) ** tables >= 0.92
    assert rt.lsh_shape(np.full(10, 0.3), 500, 8) == (24, 6)


def _mmr_plain(cands, k, lam):
    """Greedy re-rank of [(score, text)] with dense numpy cosines."""
    from collections import Counter
    bags = [Counter((t or "").lower().split()) for _, t in cands]
    words = sorted({w for b in bags for w in b})
    m = np.array([[b[w] for w in words] for b in bags], float).reshape(len(bags), -1)
    norm = np.sqrt((m * m).sum(1))
    g = np.divide(m @ m.T, np.outer(norm, norm), out=np.zeros((len(m), len(m))), where=np.outer(norm, norm) > 0)
    r = np.array([s or 0.0 for s, _ in cands])
    r = r / r.max() if r.max() > 0 else r
    if len(r) <= k:
        return list(range(len(r)))
    taken = []
    while len(taken) < k:
        value = [(-1e9 if i in taken else lam * r[i] - (1 - lam) * max((g[i, j] for j in taken), default=0.0)) for i in range(len(r))]
        taken.append(int(np.argmax(value)))
    return taken


def test_mmr_of_many_candidates(spark):
    """80 candidates and 20 picks a question, against numpy."""
    import time
    rng = np.random.default_rng(8)
    vocabulary = [f"w{i}" for i in range(400)]
    questions = {q: [(round(1 - i / 100, 3), " ".join(rng.choice(vocabulary, 120))) for i in range(80)] for q in range(40)}
    rows = [(q, i, s, i + 1, t) for q, c in questions.items() for i, (s, t) in enumerate(c)]
    cands = spark.createDataFrame(rows, "qid int, iid int, score double, rank int, chunk_text string")
    t0 = time.time()
    got = {}
    for r in rt.mmr(cands, 20).orderBy("qid", "mmr_rank").collect():
        got.setdefault(r["qid"], []).append(r["iid"])
    assert time.time() - t0 < 60
    assert got == {q: _mmr_plain(c, 20, rt.MMR_LAMBDA) for q, c in questions.items()}


def test_postings_store_ids_once_an_item(spark):
    """Entries take a few bytes each on disk however long the ids are; an id that occurs again is one item."""
    import hashlib
    import os

    from quire.operators.postings import build_postings
    rng = np.random.default_rng(5)
    rows = [(hashlib.sha256(str(i).encode()).hexdigest(), " ".join(f"w{x}" for x in rng.integers(0, 3000, 200))) for i in range(1500)]
    items = spark.createDataFrame(rows, "chunk_id string, chunk_text string")
    index = build_postings(items, "chunk_id", "chunk_text")
    files = {f.replace("file://", "").replace("file:", "") for f in index.lists.inputFiles()}
    entries = index.terms.agg(F.sum("df")).first()[0]
    assert sum(os.path.getsize(f) for f in files) < 8 * entries
    q = spark.createDataFrame([(1, rows[7][1][:60])], "qid int, q string")
    got = rt.bm25(q, index, 5, "qid", "q", "chunk_id", "chunk_text")
    assert _rows(got, "iid", "score", "rank") == _rows(rt.bm25(q, items, 5, "qid", "q", "chunk_id", "chunk_text"), "iid", "score", "rank")
    twice = build_postings(items.unionByName(items.limit(8)), "chunk_id", "chunk_text")
    got = rt.bm25(q, twice, 5, "qid", "q", "chunk_id", "chunk_text").collect()
    assert len({r["iid"] for r in got}) == len(got) == 5


def test_bounded_scores_equal_all_scores():
    """Given the least score of a list so far, a block gives the same list: ties, zero, opposite and bad vectors, filters."""
    import pandas as pd

    from quire.operators import topk
    rng = np.random.default_rng(11)
    v = np.round(rng.normal(size=(900, 4)), 1)
    v[::50], v[7], v[8] = 0.0, v[3], -v[3]
    types = np.array(["csv", "pdf"])[rng.integers(0, 2, 900)]
    items = pd.DataFrame({"iid": rng.permutation(900), "embedding": list(v), topk.TYPE_COL: types})
    asked = pd.DataFrame({"qid": np.arange(60), "qvec": list(v[:60]), topk.FILTER_COL: [None, "csv", "pdf"] * 20})
    for exclude_self in (False, True):
        for part in (items, pd.concat([items, items.head(1).assign(iid=5000, embedding=[np.array([np.nan] * 4)])], ignore_index=True)):
            bound = topk.cosine_scorer(5, exclude_self=exclude_self)
            used = []
            real = bound._reaching
            bound._reaching = lambda *a: used.append(1) or real(*a)
            plain = topk.cosine_scorer(5, exclude_self=exclude_self)
            plain.bounded = False
            a, b = (topk._score_items(part, [asked], s, 5, 100, {})[0].reset_index(drop=True) for s in (bound, plain))
            assert a.equals(b) and len(a) == 300 and used


def test_grid_query_blocks_follow_bytes(spark, monkeypatch):
    """Items are shuffled once for a block of queries of some megabytes, not for every 16,384 rows."""
    from quire.operators import topk
    shuffled = []
    real = topk.keyed_partial_top_k
    monkeypatch.setattr(topk, "keyed_partial_top_k", lambda i, *a: shuffled.append(i.count()) or real(i, *a))
    items = spark.createDataFrame([(i, f"w{i % 7} common") for i in range(40)], "iid long, t string")
    q = spark.range(20_000).select(F.col("id").alias("qid"), F.concat(F.lit("w"), F.col("id") % 7).alias("q"))
    hits = rt.bm25(q, items, 3, "qid", "q", "iid", "t", mode="grid")
    assert hits.count() == 60_000 and shuffled == [40]


def test_cell_groups_are_bounded(spark, monkeypatch):
    """A cell's queries meet it in blocks; the hits are those of whole groups."""
    from quire.operators import cells, topk
    rng = np.random.default_rng(2)
    e = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=4)]) for i in range(400)], "vec_id int, embedding array<double>")
    index = cells.build_cells(e, "vec_id", cells=4)
    q = e.select("vec_id", F.col("embedding").alias("qvec"))
    keys, sizes = [], []
    real = topk.keyed_partial_top_k

    def seen(items, queries, by, *a):
        keys.append(by)
        sizes.append(queries.groupBy(*by).count().agg(F.max("count")).first()[0])
        return real(items, queries, by, *a)

    monkeypatch.setattr(topk, "keyed_partial_top_k", seen)
    whole = _rows(cells.search_cells(index, q, 5, "vec_id", probes=4, exclude_self=True), "qid", "iid", "score", "rank")
    monkeypatch.setattr(cells, "GROUP_QUERIES", 50, raising=False)
    parts = _rows(cells.search_cells(index, q, 5, "vec_id", probes=4, exclude_self=True), "qid", "iid", "score", "rank")
    assert parts == whole and sizes[0] == 400 and sizes[1] < 100


def test_items_of_a_batch_become_objects_few_at_a_time():
    """However many rows an Arrow batch has, a frame has at most the rows asked for and keeps
    the terms in Arrow; the scorer gives the same from both forms."""
    import pandas as pd
    import pyarrow as pa

    from quire.operators import topk
    lists = [["a", "b", "a"], [], ["b"], ["c", None], ["a"]] * 3
    batch = pa.RecordBatch.from_arrays([pa.array(range(15), pa.int64()), pa.array(lists, pa.list_(pa.string()))], ["iid", "toks"])
    frames = list(topk._item_frames(batch, 4))
    assert [len(f) for f in frames] == [4, 4, 4, 3] and all(isinstance(f["toks"].dtype, pd.ArrowDtype) for f in frames)
    asked = pd.DataFrame({"qid": [1, 1, 2], "term": ["a", "b", "c"], "idf": [1.0, 0.5, 2.0]})
    plain = pd.DataFrame({"iid": range(15), "toks": [np.array(x, dtype=object) for x in lists]})
    scorer, got, want = topk.bm25_scorer(3, avgdl=1.4), {}, {}
    for f in frames:
        got = topk._score_items(f, [asked], scorer, 3, 4, got)
    want = topk._score_items(plain, [asked], scorer, 3, 4, want)
    assert got[0].reset_index(drop=True).astype({"iid": int}).equals(want[0].reset_index(drop=True).astype({"iid": int})) and len(got[0]) == 6


def test_postings_of_a_bucket_are_few_files_and_rows(spark):
    """A bucket's terms are one file, and its lists of a block and type one row, however many tasks and terms there are."""
    from quire.operators import postings as po
    rows = [(i, " ".join(f"t{(i * 7 + j) % 4000}" for j in range(40)), ["csv", None][i % 2]) for i in range(1200)]
    items = spark.createDataFrame(rows, "chunk_id int, chunk_text string, source_type string").repartition(4, "chunk_id")
    index = po.build_postings(items, "chunk_id", "chunk_text", "source_type", buckets=8)
    assert len(index.terms.inputFiles()) == index.terms.select("bucket").distinct().count() == 8
    stored = spark.read.parquet(index.lists.inputFiles()[0].split("/lists/")[0] + "/lists")
    assert stored.where("bucket >= 0").count() == 4 * 2 * 8
    terms = index.lists.groupBy("term").agg(F.sum(F.size("at")).alias("n")).orderBy("term").collect()
    want = {}
    for _, text, _ in rows:
        for t in set(text.split()):
            want[t] = want.get(t, 0) + 1
    assert {r["term"]: r["n"] for r in terms} == want == {r["term"]: r["df"] for r in index.terms.collect()}


def test_blocks_are_bounded_by_items_and_terms(monkeypatch):
    """Blocks run over batches up to both bounds and give every entry; numbers that don't follow begin a block."""
    import pyarrow as pa

    from quire.operators import postings as po
    monkeypatch.setattr(po, "BLOCK", 7)
    monkeypatch.setattr(po, "BLOCK_TERMS", 12)
    words = [[f"w{j % 5}" for j in range(i % 6)] for i in range(30)]
    words[11] = ["long"] * 40
    numbers = [*range(20), *range(100, 110)]
    batches = [pa.RecordBatch.from_arrays([pa.array(numbers[a:b]), pa.array([str(n) for n in numbers[a:b]]), pa.array(["x", "y", ""] * 10)[a:b],
                                           pa.array(words[a:b], pa.list_(pa.string()))], ["number", "iid", "type", "toks"])
               for a, b in ((0, 4), (4, 20), (20, 30))]
    got, ids, sizes = {}, {}, []
    for r in pa.Table.from_batches(list(po._blocks(pa.string(), 4)(iter(batches)))).to_pylist():
        if r["bucket"] == po.IDS:
            assert len(r["ids"]) <= 7 and (len(r["ids"]) == 1 or sum(r["dl"]) <= 12)
            sizes.append(len(r["ids"]))
            ids |= {r["base"] + i: (x, n) for i, (x, n) in enumerate(zip(r["ids"], r["dl"]))}
            continue
        for e in r["lists"]:
            for at, tf, dl in zip(e["at"], e["tf"], e["dl"]):
                assert (key := (e["term"], r["base"] + at)) not in got
                got[key] = tf, dl, r["type"]
    assert len(sizes) < 30 and ids == {n: (str(n), len(w)) for n, w in zip(numbers, words)}
    assert got == {(t, n): (w.count(t), len(w), ["x", "y", ""][i % 3]) for i, (n, w) in enumerate(zip(numbers, words)) for t in w}


def test_bounded_bm25_equals_all_scores(monkeypatch):
    """Common terms by a product, others entry by entry, pairs below a list left out: the same lists, with filters and ties."""
    import pandas as pd

    from quire.operators import topk
    rng = np.random.default_rng(3)
    words = np.array([f"w{i}" for i in range(60)])
    docs = [list(words[np.minimum(rng.geometric(0.08, size=rng.integers(0, 40)) - 1, 59)]) for _ in range(700)]
    docs[5] = docs[6] = docs[400]
    items = pd.DataFrame({"iid": [f"d{i:03d}" for i in rng.permutation(700)], "toks": [np.array(d, dtype=object) for d in docs],
                          topk.TYPE_COL: np.array(["csv", "pdf", None], dtype=object)[rng.integers(0, 3, 700)]})
    asked = pd.DataFrame([(q, t, 1.0 + 0.1 * int(t[1:]), [None, "csv", "pdf"][q % 3]) for q in range(50) for t in set(rng.choice(words, 9))],
                         columns=["qid", "term", "idf", topk.FILTER_COL])
    avgdl, k1, b = 12.0, 1.2, 0.75
    want = {}
    for q, rows in asked.groupby("qid"):
        scores = []
        for iid, d, kind in zip(items["iid"], docs, items[topk.TYPE_COL]):
            s = sum(w * d.count(t) * (k1 + 1) / (d.count(t) + k1 * (1 - b + b * len(d) / avgdl)) for t, w in zip(rows["term"], rows["idf"]) if t in d)
            if s > 0 and rows[topk.FILTER_COL].iloc[0] in (None, kind):
                scores.append((-round(s, 6), iid))
        want[q] = sorted(scores)[:5]
    for common, looked, queries in ((0.015, 1 << 15, 1024), (0.3, 7, 16), (2.0, 100, 7)):
        monkeypatch.setattr(topk.BM25Scorer, "COMMON", common)
        monkeypatch.setattr(topk.BM25Scorer, "LOOKED", looked)
        monkeypatch.setattr(topk.BM25Scorer, "QUERIES", queries)
        scorer = topk.bm25_scorer(5, avgdl=avgdl)
        lists = topk._fold(items, scorer.pack(asked), scorer, 5, 100, {})
        got = pd.concat([x.frame() for x in lists.values()])
        assert {q: [(-s, i) for s, i in zip(g["score"], g["iid"])] for q, g in got.groupby("qid")} == {
            q: [(s, i) for s, i in w] for q, w in want.items() if w}


def test_lsh_blocks_equal_joined_buckets(spark, monkeypatch):
    """Candidates are found block by block, none is shuffled as a row: pairs, scores and their number are those of
    a join of buckets, with ids that occur again, zero vectors and null ids; few tables of many bits too."""
    from quire.operators import blocks
    rng = np.random.default_rng(9)
    v = np.round(rng.normal(size=(600, 8)), 2)
    v[3], v[9] = 0.0, v[8]
    rows = [(i, x) for i, x in enumerate(v.tolist())] + [(5, v[5].tolist()), (7, v[7].tolist()), (None, v[20].tolist())]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    q = e.select("vec_id", F.col("embedding").alias("qvec"))
    monkeypatch.setattr(blocks, "BLOCK_BYTES", 150 * 8 * 8)
    monkeypatch.setattr(blocks, "TILE", 2000)
    monkeypatch.setattr(blocks, "HEAD", 20)
    ids, all_v = np.array([r[0] for r in rows[:-1]]), np.array([r[1] for r in rows[:-1]])
    for tables, target in ((6, 30), (3, 0.02)):
        bits = rt.lsh_bits(len(rows), target)
        planes = rt.lsh_planes(8, tables, bits)
        code = (np.einsum("tbd,nd->ntb", planes, all_v) > 0) @ (1 << np.arange(bits))
        apart = code[:, None, :] ^ code[None, :, :]
        near = ((apart & (apart - 1)) == 0).any(axis=2) & (ids[:, None] != ids)
        want = {(int(a), int(b)) for a, b in zip(*(ids[x] for x in np.nonzero(near)))}
        how = dict(exclude_self=True, tables=tables, target_bucket=target)
        got = [tuple(r) for r in rt.lsh_pairs(q, e, "vec_id", "vec_id", **how).collect()]
        assert len(got) == len(set(got)) and set(got) == want
        cells = rt.lsh_pairs(q, e, "vec_id", "vec_id", as_rows=False, **how)
        assert min(cells.blocks) >= 4
        told = rt.score_pairs(cells, q, e, "vec_id", "vec_id", k=4)
        assert told.agg(F.sum("pairs")).first()[0] == len(want) and told.where("pairs is null").count() <= 4 * len(rows) * cells.blocks[0]
        plain = rt._merge(rt.score_pairs(rt.lsh_pairs(q, e, "vec_id", "vec_id", **how), q, e, "vec_id", "vec_id"), 4)
        best = rt.knn_lsh(q, e, 4, "vec_id", "vec_id", **how)
        assert _rows(best, "qid", "iid", "score", "rank") == _rows(plain, "qid", "iid", "score", "rank")
