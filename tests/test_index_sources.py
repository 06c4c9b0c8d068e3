import os

import pytest
from pyspark.sql import functions as F

from quire.operators.index import diff_snapshots, index_status, sync_index
from quire.sources import files as fs
from quire.sources import pages as pg


def test_sync_index_cases_and_idempotence(spark):
    target = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, v string")
    source = spark.createDataFrame([(1, "a"), (2, "B"), (4, "d")], "k int, v string")
    changes, new_target = sync_index(source, target, ["k"], ["v"])
    assert sorted(tuple(r) for r in changes.collect()) == [(1, "unchanged"), (2, "update"), (3, "delete"), (4, "insert")]
    assert sorted(tuple(r) for r in new_target.collect()) == [(1, "a"), (2, "B"), (4, "d")]
    again = diff_snapshots(source, new_target, ["k"], ["v"])
    assert {r["op"] for r in again.collect()} == {"unchanged"}
    st = index_status(source, target, ["k"], ["v"]).first()
    assert (st["indexed"], st["missing"], st["stale"], st["extra"], st["ready"]) == (3, 1, 1, 1, False)


@pytest.fixture()
def file_tree(tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "empty").mkdir()
    (tmp_path / "a.csv").write_text("name,uses\nginger,\"digestion, \"\"warm\"\"\ncold\"\n")
    (tmp_path / "B.CSV").write_text("uses,name\nsleep,ashwagandha\n")
    (tmp_path / "c.pdf").write_bytes(b"%PDF-fake")
    (tmp_path / ".placeholder").write_text("")
    (tmp_path / "d" / "e.csv").write_text("name,uses\ntulsi,cough\n")
    return tmp_path


def test_discover_and_classify(spark, file_tree):
    files = fs.classify_files(fs.discover_files(spark, str(file_tree)))
    kinds = sorted((r["name"], r["kind"]) for r in files.collect())
    assert kinds == [("B.CSV", "csv"), ("a.csv", "csv"), ("c.pdf", "pdf"), ("e.csv", "csv")]
    with pytest.raises(fs.MissingInput, match="does not exist"):
        fs.require_files(spark, str(file_tree / "missing"))
    with pytest.raises(fs.MissingInput, match="no files"):
        fs.require_files(spark, str(file_tree / "empty"))


def test_read_csv_binds_by_name(spark, file_tree):
    paths = [str(file_tree / "a.csv"), str(file_tree / "B.CSV"), str(file_tree / "d" / "e.csv")]
    df = fs.read_csv(spark, paths)
    got = sorted((r["name"], r["uses"], r["source_file"]) for r in df.collect())
    assert got == [("ashwagandha", "sleep", "B.CSV"), ("ginger", 'digestion, "warm"\ncold', "a.csv"),
                   ("tulsi", "cough", "e.csv")]


def test_extract_pages_with_fallback_and_failures(spark):
    def broken(content, name):
        raise RuntimeError("cannot parse")

    rows = [(b"<html><script>x</script><p>Hello &amp; bye</p></html>", "a.html"),
            (b"page one\fpage two", "b.txt"), (b"\xff\xfe\xfa", "c.bin")]
    files = spark.createDataFrame(rows, "content binary, source_file string")
    chain = [("broken", broken), ("text", pg.text_extractor)]
    out = pg.extract_pages(files, chain).collect()
    good = sorted((r["source_file"], r["page_number"], r["page_text"]) for r in out if r["error"] is None)
    bad = [r for r in out if r["error"] is not None]
    assert ("b.txt", 2, "page two") in good and len(bad) == 1 and "cannot parse" in bad[0]["error"]
    assert pg.html_extractor(rows[0][0], "a.html") == ["Hello & bye"]


def test_assemble_documents(spark):
    pages = spark.createDataFrame([("f", 2, " second "), ("f", 1, "first"), ("f", 3, "  "), ("g", 1, "only")],
                                  "source_file string, page_number int, page_text string")
    out = {r["source_file"]: (r["page_count"], r["document_text"]) for r in pg.assemble_documents(pages).collect()}
    assert out == {"f": (2, "first\n\nsecond"), "g": (1, "only")}


def test_html_text_native(spark):
    df = spark.createDataFrame([("<style>p{}</style><!-- c --><p>A &lt;b&gt; &amp;amp;</p>",)], "h string")
    assert df.select(pg.html_text("h")).first()[0] == "A <b> &amp;"


def test_write_snapshot_refuses_empty(spark, tmp_path):
    empty = spark.createDataFrame([], "a int")
    with pytest.raises(ValueError):
        fs.write_snapshot(empty, "t_empty", path=str(tmp_path / "t"))
    assert os.path.exists(tmp_path)


def test_build_corpus_from_files(spark, tmp_path):
    from quire.plans.corpus import build_corpus
    words = " ".join(f"word{i}" for i in range(30))
    (tmp_path / "herbs.csv").write_text(f"condition,diet,extra\ncold,\"ginger tea, honey and {words}\",x\n")
    (tmp_path / "book.html").write_text(f"<html><body><p>Turmeric milk at night. {words}</p></body></html>")
    (tmp_path / "notes.txt").write_text(f"page one {words}\fpage two {words}")
    chunks, failed = build_corpus(spark, str(tmp_path), size=20, overlap=5)
    rows = chunks.collect()
    by_type = {}
    for r in rows:
        by_type.setdefault(r["source_type"], set()).add(r["source_file"])
    assert by_type == {"csv": {"herbs.csv"}, "html": {"book.html"}, "txt": {"notes.txt"}}
    assert any(r["chunk_text"].startswith("Source: csv | Condition: cold | Diet: ginger tea") for r in rows)
    assert {r["page_number"] for r in rows if r["source_file"] == "notes.txt"} == {1, 2}
    assert len({r["chunk_id"] for r in rows}) == len(rows) and failed.count() == 0
    again = {r["chunk_id"] for r in build_corpus(spark, str(tmp_path), size=20, overlap=5)[0].collect()}
    assert again == {r["chunk_id"] for r in rows}


def test_catalog_helpers(spark, tmp_path):
    fs.ensure_namespace(spark, "quire_test")
    df = spark.createDataFrame([(1, "a")], "a int, b string")
    fs.write_snapshot(df, "quire_test.snap", path=str(tmp_path / "snap"))
    got = fs.load_checked(spark, "quire_test.snap", ["a", "b"])
    assert got.count() == 1
    with pytest.raises(ValueError, match="lacks columns"):
        fs.load_checked(spark, "quire_test.snap", ["a", "zzz"])
    fb = fs.table_or_fallback(spark, "quire_test.absent", lambda: df.limit(0))
    assert fb.count() == 0
    assert fs.table_or_fallback(spark, "quire_test.snap", lambda: None).count() == 1


def test_build_corpus_reads_nested_files(spark, tmp_path):
    from quire.plans.corpus import build_corpus
    words = " ".join(f"word{i}" for i in range(30))
    sub = tmp_path / "sub dir" / "deep"
    sub.mkdir(parents=True)
    (tmp_path / "top.html").write_text(f"<p>Top {words}</p>")
    (sub / "nested.HTML").write_text(f"<p>Nested {words}</p>")
    (sub / "n.csv").write_text(f"diet,condition\n\"tea {words}\",cold\n")
    (tmp_path / "m.csv").write_text(f"condition,diet\nfever,\"soup {words}\"\n")
    (sub / "bad.pdf").write_bytes(b"%PDF")
    chunks, failed = build_corpus(spark, str(tmp_path), size=400, overlap=5)
    got = {r["source_file"] for r in chunks.collect()} | {r["source_file"] for r in failed.collect()}
    assert got == {"top.html", "nested.HTML", "n.csv", "m.csv", "bad.pdf"}


def test_line_filter_sees_lines_of_html(spark):
    df = spark.createDataFrame([("<html><p>Ginger: warm root for cold days</p><p>www.example.com</p><ul><li>doi 10.1</ul></html>",)],
                               "h string")
    lines = [x.strip() for x in df.select(pg.html_lines("h")).first()[0].split("\n") if x.strip()]
    assert lines == ["Ginger: warm root for cold days", "www.example.com", "doi 10.1"]
    pages = df.select(pg.html_lines("h").alias("page_text"), F.lit("f").alias("source_file"), F.lit(1).alias("page_number"))
    assert "warm root" in pg.page_records(pages, "structured").first()["raw_text"]
    assert pg.html_extractor(b"<p>a b</p><p>c</p>", "f") == ["a b\nc"]


def test_pages_and_arriving_files_in_pieces(spark, monkeypatch, tmp_path):
    """Tasks and files are pieces of a fixed size, so none grows with the input; the rows stay."""
    from quire.plans import catalog
    from quire.sources.files import finer
    sf = str(tmp_path)
    rows = [(i, f"https://h.example/p{i // 3}?page={i % 3}", f"<p>Ginger {i}</p><p>Used for: cough and cold, {'tea ' * (i % 7)}</p>")
            for i in range(900)]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{sf}/pages.parquet")
    texts = [(i, " ".join(f"w{i * 31 + j * j}" for j in range(120 + 9 * i)), "s", "en", 0) for i in range(60)]
    spark.createDataFrame(texts, "doc_id long, text string, source string, lang string, n_chars long").coalesce(1).write.parquet(
        f"{sf}/documents.parquet")
    df = catalog.pages_table(spark, sf)
    assert finer(df, ["page_id"], 1).rdd.getNumPartitions() == df.rdd.getNumPartitions()
    whole = sorted(map(tuple, catalog.q_page_structured(spark, sf).collect()), key=str)
    monkeypatch.setattr(catalog, "PAGE_BYTES", 512)
    assert catalog.page_rows(spark, sf).rdd.getNumPartitions() > 10
    assert sorted(map(tuple, catalog.q_page_structured(spark, sf).collect()), key=str) == whole
    monkeypatch.setattr(catalog, "ARRIVING_BYTES", 8 << 10)
    assert catalog._stored_pieces(spark, sf, "documents", 8 << 10) > 8
    target = sorted(map(tuple, catalog.q_stream_late(spark, sf).collect()))
    assert target == sorted(map(tuple, catalog.q_stream_sync(spark, sf).collect()))
    assert target == sorted(map(tuple, catalog._snapshots(spark, sf)[0].collect()))
