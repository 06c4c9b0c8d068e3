"""Stored index versions (S13), order across stream batches (R1), k-means cells."""

import uuid

import numpy as np
from pyspark.sql import functions as F

from quire.operators import cells as ce
from quire.operators import index as ix
from quire.operators import retrieval as rt
from quire.session import checkpoint_dir
from quire.streaming.sync import stream_sync

KEY, VALUES = ["k"], ["v"]


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_refresh_reads_changed_buckets_only(spark):
    path = f"{checkpoint_dir(spark)}/ix-{uuid.uuid4().hex}"
    one = spark.range(500).select(F.col("id").cast("int").alias("k"), F.concat(F.lit("v"), "id").alias("v"))
    ix.create_index(one, path, KEY, VALUES, buckets=32)
    two = one.where("k <> 7").withColumn("v", F.when(F.col("k") == 9, "new").otherwise(F.col("v"))).unionByName(
        spark.createDataFrame([(1000, "in"), (None, None)], "k int, v string"))
    changed = ix.changed_buckets(ix.digest_tree(two, KEY, VALUES, 32), ix.digest_tree(one, KEY, VALUES, 32))
    assert 1 <= len(changed) <= 4
    assert ix.refresh_index(two, path, KEY, VALUES, 32) == 1
    assert _rows(ix.change_log(spark, path, two.schema, KEY)) == sorted(
        [(1, 7, "delete"), (1, 9, "update"), (1, 1000, "insert"), (1, None, "insert")], key=str)
    assert _rows(ix.read_index(spark, path, two.schema, KEY, VALUES)) == _rows(two)
    assert _rows(ix.read_index(spark, path, two.schema, KEY, VALUES, version=0)) == _rows(one)
    plan = ix.stored_rows(spark, path, two.schema, KEY, VALUES, 0, changed)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "_bucket#" in plan.split("PartitionFilters")[1].split("]")[0]
    assert ix.refresh_index(two, path, KEY, VALUES, 32) == 2                    # nothing changed: an empty log
    assert ix.change_log(spark, path, two.schema, KEY).where("version = 2").count() == 0
    assert ix.refresh_index(one, path, KEY, VALUES, 32) == 3 and _rows(ix.read_index(spark, path, one.schema, KEY, VALUES)) == _rows(one)
    assert ix.refresh_index(one.limit(0), path, KEY, VALUES, 32) == 4
    assert ix.read_index(spark, path, one.schema, KEY, VALUES).count() == 0


def test_digests_do_not_depend_on_order(spark):
    a = spark.createDataFrame([(i, f"v{i % 3}") for i in range(50)], "k int, v string")
    assert ix.changed_buckets(ix.digest_tree(a, KEY, VALUES, 8), ix.digest_tree(a.orderBy(F.desc("k")).repartition(3), KEY, VALUES, 8)) == []


def test_newest_row_wins_across_batches(spark):
    root = f"{checkpoint_dir(spark)}/late-{uuid.uuid4().hex}"
    ddl = "k int, v string, seq int, deleted boolean"

    def arrive(*rows):
        spark.createDataFrame(rows, ddl).coalesce(1).write.mode("append").parquet(f"{root}/in")
        schema = spark.createDataFrame([], ddl).schema
        return _rows(stream_sync(spark, f"{root}/in", f"{root}/target", schema, KEY, VALUES, f"{root}/ckpt", buckets=2,
                                 deleted_col="deleted", order_col="seq"))

    assert arrive((1, "new", 5, False), (2, "b", 5, False), (None, "n", 1, False)) == [(1, "new"), (2, "b"), (None, "n")]
    assert arrive((1, "late", 3, False), (2, "", 6, True), (None, "n2", 2, False)) == [(1, "new"), (None, "n2")]
    assert arrive((2, "late", 4, False), (3, "c", None, False)) == [(1, "new"), (3, "c"), (None, "n2")]
    assert arrive((2, "back", 7, False), (3, "d", 0, False)) == [(1, "new"), (2, "back"), (3, "d"), (None, "n2")]


def _vectors(spark, clustered, n, dim=32):
    rng = np.random.default_rng(n)
    v = rng.normal(size=(n, dim))
    if clustered:
        v = v * 0.3 + rng.normal(size=(20, dim))[rng.integers(0, 20, n)]
    return spark.createDataFrame([(i, x) for i, x in enumerate(v.round(4).tolist())], "vec_id long, embedding array<double>")


def test_cells_find_neighbours(spark):
    """Recall from measured probes; on vectors with structure a fraction of all pairs."""
    shares = {}
    for clustered, n in ((True, 2000), (True, 8000), (False, 2000)):
        e = _vectors(spark, clustered, n).repartition(4)
        q = e.where("vec_id < 100").select("vec_id", F.col("embedding").alias("qvec"))
        index = ce.build_cells(e, "vec_id")
        good = q.select(F.col("vec_id").alias("qid"), "qvec")
        probes = ce.measured_probes(index, good, 5, True)
        got = ce.search_cells(index, q, 5, "vec_id", exclude_self=True)
        exact = rt.knn(q, e, 5, "vec_id", "vec_id", exclude_self=True)
        assert rt.recall_at_k(got, exact).first()["recall"] >= 0.9
        assert got.join(exact, ["qid", "iid"]).where(got.score != exact.score).count() == 0
        shares[clustered, n] = probes / len(index.centroids)
    print(shares)
    assert shares[True, 8000] < shares[True, 2000] < 0.2


def test_cells_of_many_vectors_ties_and_bad_vectors(spark, monkeypatch):
    rows = [(i, [1.0, 0.0]) for i in range(40)] + [(100 + i, [0.0, 1.0]) for i in range(5)]
    rows += [(200, None), (201, []), (202, [float("nan"), 1.0]), (203, [1.0, 2.0, 3.0]), (204, [0.0, 0.0])]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    monkeypatch.setattr(ce.topk, "GRID_ITEMS", 7)                     # a cell in several blocks
    index = ce.build_cells(e.coalesce(1), "vec_id", cells=3)
    q = spark.createDataFrame([(1, [2.0, 0.1]), (2, [0.0, 3.0]), (3, None)], "qid long, qvec array<double>")
    got = _rows(ce.search_cells(index, q, 3, "qid", probes=3).select("qid", "rank", "iid"))
    assert got == [(1, 1, 0), (1, 2, 1), (1, 3, 2), (2, 1, 100), (2, 2, 101), (2, 3, 102)]
    assert ce.search_cells(ce.build_cells(e.limit(0), "vec_id"), q, 3, "qid").collect() == []


def test_index_reads_its_source_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    path = f"{checkpoint_dir(spark)}/ix-{uuid.uuid4().hex}"
    rows = spark.range(300).select(F.col("id").cast("int").alias("k"), F.concat(F.lit("v"), "id").alias("v"))
    ix.create_index(rows.mapInArrow(count, rows.schema), path, KEY, VALUES, 8)
    assert seen.value == 300
    two = rows.where("k <> 7").unionByName(spark.createDataFrame([(7, "new"), (None, None)], "k int, v string"))
    ix.refresh_index(two.mapInArrow(count, two.schema), path, KEY, VALUES, 8)
    assert seen.value == 601
    assert _rows(ix.read_index(spark, path, two.schema, KEY, VALUES)) == _rows(two)


def test_cell_search_sends_a_query_once_a_block(spark, monkeypatch):
    """A vector goes to blocks, not to every cell it probes; the rows are those of the probed cells."""
    import numpy as np

    from quire.operators import blocks, cells
    rng = np.random.default_rng(7)
    v = rng.normal(size=(900, 6)).round(3)
    v[13] = v[14]
    v[20] = 0.0
    e = spark.createDataFrame([(i, x) for i, x in enumerate(v.tolist())], "vec_id long, embedding array<double>").repartition(5)
    index = cells.build_cells(e, "vec_id")
    probes = int(0.4 * len(index.centroids))
    sent, dealt = [], blocks.deal
    monkeypatch.setattr(blocks, "BLOCK_BYTES", 300 * 6 * 8)
    monkeypatch.setattr(blocks, "TILE", 1000)
    monkeypatch.setattr(blocks, "deal", lambda items, queries, *a: (sent.append((queries, a)), dealt(items, queries, *a))[1])
    hits = cells.search_cells(index, e.select("vec_id", e.embedding.alias("qvec")), 5, "vec_id", probes=probes, exclude_self=True)
    got = {(r.qid, r["rank"]): (r.iid, r.score) for r in hits.collect()}
    queries, n = sent[0]
    assert n == (3, 3) and queries.count() == 900 and max(len(r.ibs) for r in queries.select("ibs").collect()) <= 3 < probes
    near = cells._nearest(v, index.centroids, probes)
    s = np.round(cells.cosines(v, v), 6)
    for q in range(900):
        items = [i for i in range(900) if i != q and near[i, 0] in near[q]]
        want = sorted(items, key=lambda i: (-s[q, i], i))[:5]
        assert [got[q, r + 1] for r in range(5)] == [(i, s[q, i]) for i in want]


def test_upsert_merges_a_share_of_the_buckets_at_a_time(spark, monkeypatch, tmp_path):
    """Shares give the rows of one merge, and no table of a merge stays behind."""
    import os

    from quire.session import checkpoint_dir
    from quire.streaming import sync
    staged, kept = [], sync.store
    monkeypatch.setattr(sync, "store", lambda df, label: (staged.append(x := kept(df, label)), x)[1])
    tables = f"{checkpoint_dir(spark).replace('file://', '')}/tables"
    before = set(os.listdir(tables)) if os.path.isdir(tables) else set()
    rows = [(i, f"v{i}", False, 2) for i in range(200)] + [(i, None, True, 2) for i in range(200, 230)]
    late = [(i, f"old{i}", False, 1) for i in range(260)] + [(None, "null key", False, 1)]
    for n, some in enumerate((rows, late)):
        spark.createDataFrame(some, "id long, v string, gone boolean, seq int").write.mode("append").parquet(f"{tmp_path}/in")
        schema = spark.read.parquet(f"{tmp_path}/in").schema
        out = sync.stream_sync(spark, f"{tmp_path}/in", f"{tmp_path}/to", schema, ["id"], ["v"], f"{tmp_path}/progress", buckets=12,
                               deleted_col="gone", order_col="seq")
    want = {(i, f"v{i}") for i in range(200)} | {(i, f"old{i}") for i in range(230, 260)} | {(None, "null key")}
    assert {tuple(r) for r in out.collect()} == want and out.count() == len(want)
    assert len(staged) == 6 and set(os.listdir(tables)) <= before
