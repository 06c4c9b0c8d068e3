"""Files -> processed chunk table (the batch build of SURVEY section 3.1).

discover (S1) -> classify (S2) -> CSV rows by header group (S4, D9) ->
labelled records (P3-P5) | page files -> extractor chain (S5, S6) -> page
records (T6/T5) -> union (U1) -> chunks (C6) -> optional snapshot (S10).
Every step is a DataFrame transformation; file bytes are read and parsed in
executors, and only the file listing (paths) is known to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import chunks as ch
from quire.sources import files as fs
from quire.sources import pages as pg
from quire.session import materialize

# Per file kind a chain of extractors, or a reader (spark, path, kind) -> page rows; a PDF
# parser plugs in under "pdf".
DEFAULT_EXTRACTORS = {"html": [("html", pg.html_extractor)], "txt": pg.text_pages, "pdf": []}


def build_corpus(spark: SparkSession, path: str, size: int = 350, overlap: int = 90,
                 extractors=DEFAULT_EXTRACTORS, strategy: str = "raw") -> tuple[DataFrame, DataFrame]:
    """(chunks, failed files). ``chunks`` has the central schema; failed
    files carry the extractor errors."""
    files = fs.classify_files(fs.require_files(spark, path))
    parts = []
    csv_paths = [r["path"] for r in files.filter(F.col("kind") == "csv").select("path").collect()]
    if csv_paths:
        parts.append(ch.csv_records(fs.read_csv(spark, csv_paths), "source_file", key="source_path"))
    failed = spark.createDataFrame([], "source_file string, error string")
    kinds = {r["kind"] for r in files.select("kind").distinct().collect()}   # a handful
    for kind, chain in extractors.items():
        if kind not in kinds:
            continue
        # pages are read by records and failures: extract once, write once
        read = (chain(spark, path, kind) if callable(chain)
                else pg.extract_pages(fs.read_binary(spark, path, kind), chain))
        pages = materialize(read, f"pages-{kind}")
        failed = failed.unionByName(pages.filter(F.col("error").isNotNull()).select("source_file", "error"))
        recs = pg.page_records(pages.filter(F.col("error").isNull()), strategy)
        parts.append(ch.to_base_records(recs, "raw_text", kind, source_file="source_file",
                                        page_number="page_number"))
    base = ch.union_all(parts) if parts else ch.empty_base(spark)
    return ch.build_chunks(base, size, overlap), failed


def embed_chunks(chunks: DataFrame, encoder=None) -> tuple[DataFrame, DataFrame]:
    """E1-E3 at build time: (chunks with a checked ``embedding``, rejected rows with
    a ``reason``). The first is ready to be written once and searched many times
    (``ask_batch`` uses it as is)."""
    from quire.functions.vectors import HashingEncoder, check_dim, embed
    encoder = encoder or HashingEncoder()
    return check_dim(embed(chunks, "chunk_text", encoder), encoder.dim)


def write_corpus(chunks: DataFrame, path: str) -> DataFrame:
    """S10 for the chunk table: Parquet partitioned by ``source_type`` so a
    source filter (P11) prunes whole directories at the scan; returns the
    table read back."""
    if chunks.isEmpty():
        raise ValueError("refusing to write an empty chunk table")
    chunks.write.mode("overwrite").partitionBy("source_type").parquet(path)
    return chunks.sparkSession.read.parquet(path)
