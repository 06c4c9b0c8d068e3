"""Chunk table stored by id, text pages read in splits, catalog round trips."""

import pytest
from pyspark.sql import functions as F

from quire.operators import retrieval as rt
from quire.operators.passages import attach_stored, store_chunks
from quire.session import drop_tables
from quire.sources import pages as pg


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _chunks(spark, n=400):
    return spark.range(n).select(F.concat(F.lit("c"), "id").alias("chunk_id"), F.concat(F.lit("text "), "id").alias("chunk_text"),
                                 F.lit("f").alias("source_file"), F.lit(None).cast("int").alias("page_number"))


@pytest.mark.parametrize("literals", [0, 1000])
def test_stored_attach_equals_plain_attach(spark, literals):
    chunks = _chunks(spark)
    # one hot chunk, a repeated hit, an id the table lacks, a null id
    rows = [(q, "c7", 1) for q in range(60)] + [(q, f"c{q}", 2) for q in range(60)]
    rows += [(1, "c7", 1), (2, "nothing", 3), (3, None, 4)]
    hits = spark.createDataFrame(rows, "qid int, iid string, rank int")
    store = store_chunks(chunks, buckets=7)
    got = attach_stored(hits, store, max_literals=literals)
    cols = ["qid", "iid", "rank", "chunk_text", "source_file", "page_number"]
    want = rt.attach(hits, chunks)
    key = lambda r: tuple(str(x) for x in r)                                     # noqa: E731
    assert sorted(map(tuple, got.select(cols).collect()), key=key) == sorted(map(tuple, want.select(cols).collect()), key=key)
    assert got.count() == 121 and rt.attach(hits, store).count() == 121
    assert attach_stored(hits.limit(0), store, max_literals=literals).count() == 0
    empty = store_chunks(chunks.limit(0), buckets=3)
    assert attach_stored(hits, empty, max_literals=literals).count() == 0


def test_stored_chunks_are_neither_shuffled_nor_sorted(spark):
    store = store_chunks(_chunks(spark), buckets=7)
    hits = spark.range(300).select(F.col("id").alias("qid"), F.concat(F.lit("c"), F.col("id") % 50).alias("iid"))
    from quire.operators.passages import fetch
    plan = _plan(fetch(hits.select("iid"), store, ("chunk_text",), max_literals=0))
    at = plan.index("ShuffledHashJoin")
    scan = plan.index("FileScan parquet")
    between = plan[at:scan].splitlines()
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))                    # noqa: E731
    above, child = [], None
    for line in reversed(plan[at:plan.index("\n", scan)].splitlines()):          # the scan and its parents up to the join
        if child is None or depth(line) < child:
            above.append(line)
            child = depth(line)
    assert between and "ShuffledHashJoin" in above[-1]
    assert not any("Exchange" in x or "Sort " in x for x in above), above
    assert "Bucketed: true" in plan
    few = _plan(fetch(hits.where("qid < 1").select("iid"), store, ("chunk_text",)))
    assert "SelectedBucketsCount: 1 out of 7" in few
    drop_tables(spark)
    assert not spark.catalog.tableExists(store.name)


def test_text_pages_of_split_files(spark, tmp_path):
    (tmp_path / "more").mkdir()
    pages = {"a b.txt": [f"page {i} of a é " + "x" * (i * 37 % 211) for i in range(300)],
             "more/Long.TXT": ["\n".join(f"line {j}" for j in range(50)) + f" {i}" for i in range(80)],
             "one+1 50%.txt": ["only"], "blank.txt": ["", "second", " "]}
    for name, texts in pages.items():
        (tmp_path / name).write_bytes("\f".join(texts).encode())
    (tmp_path / "empty.txt").write_bytes(b"")
    (tmp_path / "bad.txt").write_bytes(b"good\f\xff\xfe\fgood too")
    (tmp_path / "other.html").write_text("<p>no</p>")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500b")      # many splits a file
    try:
        df = pg.text_pages(spark, str(tmp_path))
        assert df.rdd.getNumPartitions() > 10
        shuffled = pg.text_pages(spark, str(tmp_path), max_broadcast_bytes=0)
        rows = df.collect()
        assert sorted(map(str, rows)) == sorted(map(str, shuffled.collect()))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    got = {}
    for r in rows:
        if r.error is None:
            got.setdefault(r.source_file, {})[r.page_number] = r.page_text
    for name, texts in pages.items():
        assert got[name.split("/")[-1]] == dict(enumerate(texts, 1)), name
    assert got["bad.txt"] == {1: "good", 3: "good too"}
    bad = sorted((r.source_file, r.page_number, r.page_text) for r in rows if r.error)
    assert [(b[0], b[1]) for b in bad] == [("bad.txt", 2)]
    assert "other.html" not in {r.source_file for r in rows}


def test_chunk_sizes_are_checked(spark):
    from quire.operators.chunks import staging_chunks
    df = spark.createDataFrame([("a", "b")], "t string, f string")
    with pytest.raises(ValueError, match="overlap"):
        staging_chunks(df, "t", "f", "csv", "csv_row", 10, 10)


def test_csv_file_names_are_decoded(spark, tmp_path):
    from quire.sources.files import discover_files, read_csv
    (tmp_path / "a b+c 5%.csv").write_text("x\n1\n")
    paths = [r.path for r in discover_files(spark, str(tmp_path)).collect()]
    row = read_csv(spark, paths).first()
    assert (row.source_file, row.source_path) == ("a b+c 5%.csv", paths[0])
