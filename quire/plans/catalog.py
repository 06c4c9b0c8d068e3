"""Registered queries: each takes (spark, sf_dir) and returns a DataFrame over
the whole given tables. Column names equal those of the DuckDB SQL in
``quire.plans.oracle``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as tx
from quire.functions.chunking import chunk_sentences, chunk_words
from quire.functions.language import detect_language, language_name
from quire.operators import chunks as ch
from quire.operators.rules import match_rules, validate_questions
from quire.operators.stats import length_stats
from quire.plans import fixtures as fx
from quire.plans.tables import table


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The given turns and the literal ones."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return c.unionByName(spark.createDataFrame(fx.CONVERSATIONS, c.schema))


def pages_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The given pages and the literal ones."""
    p = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return p.unionByName(spark.createDataFrame(fx.PAGES, p.schema))


def documents_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents -> base records: one 'text' record per document, file = source."""
    docs = table(spark, sf_dir, "documents")
    return ch.to_base_records(docs, "text", "text", source_file="source", key="doc_id")


def q_clean_text(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", tx.clean_text("text").alias("text_clean"))


def q_clean_document_text(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", tx.clean_document_text("text").alias("text_clean"))


def q_chunk_words(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.posexplode(chunk_words("text", 350, 90)).alias("chunk_index", "chunk_text"))


def q_chunk_sentences(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.posexplode(chunk_sentences("text", 350, 70)).alias("chunk_index", "chunk_text"))


def q_build_chunks(spark, sf_dir):
    return ch.build_chunks(documents_base(spark, sf_dir), 350, 90)


def q_quality_gates(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    d = d.unionByName(spark.createDataFrame(fx.DOCUMENTS, d.schema)).select("doc_id", tx.clean_text("text").alias("t"))
    t = F.col("t")
    # the text is clean, so the cheap clean-text forms of the gates apply
    g = d.select("doc_id", tx.clean_word_count(t).alias("word_count"), tx.clean_alpha_ratio(t).alias("alpha_ratio"),
                 tx.is_boilerplate(t).alias("is_boilerplate"))
    return g.withColumn("passes", (F.col("word_count") >= 10) & (F.col("alpha_ratio") >= 0.2) & ~F.col("is_boilerplate"))


def q_chunk_stats(spark, sf_dir):
    return length_stats(q_build_chunks(spark, sf_dir), "source_file", "chunk_text")


def q_row_to_text(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    cols = s.columns
    return s.select("s_suppkey", tx.clean_text(tx.row_to_text(cols)).alias("record_text"))


def q_staging_chunks(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    rec = s.select(F.lit("supplier.csv").alias("file"), tx.clean_text(tx.row_to_text(s.columns)).alias("t"))
    return ch.staging_chunks(rec, "t", "file", "csv", "csv_row")


def q_detect_language(spark, sf_dir):
    c = conversations(spark, sf_dir)
    code = detect_language("text")
    return c.select("conv_id", "turn", code.alias("lang_code"), language_name(code).alias("lang_name"))


def q_red_flags(spark, sf_dir):
    c = conversations(spark, sf_dir)
    return c.select("conv_id", "turn", tx.red_flag("text").alias("flagged"))


def q_match_rules(spark, sf_dir):
    c = conversations(spark, sf_dir).filter(F.col("role") == "user").select("conv_id", "turn", "text")
    return match_rules(c, "text").select("conv_id", "turn", "disease", "dosha", "advice", "matched_keywords",
                                         "confidence")


def q_validate_questions(spark, sf_dir):
    c = conversations(spark, sf_dir).filter(F.col("role") == "user")
    return validate_questions(c.select("conv_id", "turn", F.col("text").alias("question")), "question") \
        .select("conv_id", "turn", "is_valid", "reason")


def q_snippets(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", tx.snippet("text", 600).alias("snippet"))


# ---------------------------------------------------------------------------
# embeddings and retrieval
# ---------------------------------------------------------------------------

from quire.functions.vectors import HashingEncoder, embed, mean_vector  # noqa: E402
from quire.operators import retrieval as rt  # noqa: E402

EMBED_DIM = 128
RETRIEVAL_K = 20


def q_embed_hashing(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    return embed(d, "text", HashingEncoder(EMBED_DIM)).select("doc_id", "embedding")


def q_knn_centroids(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    cent = mean_vector(e, "label", "embedding", "qvec")
    hits = rt.knn(cent, e, RETRIEVAL_K, "label", "vec_id")
    return hits.select(F.col("qid").alias("label"), F.col("iid").alias("vec_id"), "score", "rank")


def q_knn_self(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    hits = rt.knn(e.select("vec_id", F.col("embedding").alias("qvec")), e, 5, "vec_id", "vec_id",
                  exclude_self=True)
    return hits.select(F.col("qid").alias("query_vec_id"), F.col("iid").alias("vec_id"), "score", "rank")


def corpus_chunks(spark, sf_dir):
    """The chunk corpus every retrieval plan searches, written once per plan
    to the checkpoint folder so its several readers do not rebuild it."""
    from quire.session import store
    return store(q_build_chunks(spark, sf_dir), "chunks")


def q_bm25(spark, sf_dir):
    chunks = corpus_chunks(spark, sf_dir).select("chunk_id", "chunk_text")
    bench = table(spark, sf_dir, "benchmark")
    hits = rt.bm25(bench, chunks, RETRIEVAL_K, "item_id", "text", "chunk_id", "chunk_text")
    return hits.select(F.col("qid").alias("item_id"), F.col("iid").alias("chunk_id"), "score", "rank")


def _hybrid_hits(spark, sf_dir, k):
    chunks = corpus_chunks(spark, sf_dir).select("chunk_id", "chunk_text")
    bench = table(spark, sf_dir, "benchmark")
    enc = HashingEncoder(EMBED_DIM)
    cvec = embed(chunks, "chunk_text", enc)
    qvec = embed(bench, "text", enc, "qvec")
    vec_hits = rt.knn(qvec, cvec, k, "item_id", "chunk_id")
    kw_hits = rt.bm25(bench, chunks, k, "item_id", "text", "chunk_id", "chunk_text")
    return rt.hybrid(vec_hits, kw_hits, k), chunks


def q_hybrid(spark, sf_dir):
    fused, _ = _hybrid_hits(spark, sf_dir, RETRIEVAL_K)
    return fused.select(F.col("qid").alias("item_id"), F.col("iid").alias("chunk_id"), "score", "rank")


def q_retrieve(spark, sf_dir):
    """M4: hybrid fetch_k candidates -> attach text -> MMR top_k."""
    from quire.session import materialize
    fused, chunks = _hybrid_hits(spark, sf_dir, rt.fetch_k_for(rt.TOP_K))
    cands = rt.attach(materialize(fused, "hits"), chunks, cols=("chunk_text",))
    picked = rt.mmr(cands, rt.TOP_K, rt.MMR_LAMBDA)
    return picked.select(F.col("qid").alias("item_id"), F.col("iid").alias("chunk_id"), "score", "mmr_rank")


# ---------------------------------------------------------------------------
# pages and index sync
# ---------------------------------------------------------------------------

from quire.operators import index as ix  # noqa: E402
from quire.sources import pages as pg  # noqa: E402


def _stored_pieces(spark, sf_dir, name, piece_bytes) -> int:
    from quire.sources.files import pieces
    return pieces(spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet"), piece_bytes)


PAGE_BYTES = 4 << 20        # stored pages a task takes: their expressions are heavy


def page_rows(spark, sf_dir, text=pg.html_text):
    from quire.sources.files import finer
    p = finer(pages_table(spark, sf_dir), ["page_id", "url"], _stored_pieces(spark, sf_dir, "pages", PAGE_BYTES))
    return p.select(pg.url_document("url").alias("doc_url"), pg.url_page_number("url").alias("page_number"),
                    text("html").alias("page_text"))


def q_page_documents(spark, sf_dir):
    return pg.assemble_documents(page_rows(spark, sf_dir), "doc_url", "page_number", "page_text")


def q_page_records(spark, sf_dir):
    recs = pg.page_records(page_rows(spark, sf_dir), "raw", "doc_url", "page_number", "page_text")
    return recs.select(F.col("doc_url").alias("source_file"), "page_number", "raw_text")


def q_page_structured(spark, sf_dir):
    recs = pg.page_records(page_rows(spark, sf_dir, pg.html_lines), "structured", "doc_url", "page_number", "page_text")
    return recs.select(F.col("doc_url").alias("source_file"), "page_number", "raw_text")


def _snapshots(spark, sf_dir, d=None):
    d = table(spark, sf_dir, "documents") if d is None else d
    old = d.select("doc_id", F.posexplode(chunk_words("text", 350, 90)).alias("chunk_index", "chunk_text"))
    new = d.select("doc_id", F.posexplode(chunk_words("text", 400, 100)).alias("chunk_index", "chunk_text"))
    return new, old


def q_index_sync(spark, sf_dir):
    new, old = _snapshots(spark, sf_dir)
    return ix.diff_snapshots(new, old, ["doc_id", "chunk_index"], ["chunk_text"])


def q_index_status(spark, sf_dir):
    new, old = _snapshots(spark, sf_dir)
    return ix.index_status(new, old, ["doc_id", "chunk_index"], ["chunk_text"])


# ---------------------------------------------------------------------------
# prompts and batch answers
# ---------------------------------------------------------------------------

from quire.operators import answer as an  # noqa: E402


def q_prompts(spark, sf_dir):
    """G1 over keyword hits: benchmark questions x top-5 BM25 chunks."""
    chunks = corpus_chunks(spark, sf_dir)
    bench = table(spark, sf_dir, "benchmark")
    hits = rt.bm25(bench, chunks.select("chunk_id", "chunk_text"), rt.TOP_K, "item_id", "text",
                   "chunk_id", "chunk_text")
    from quire.session import materialize
    ctx = rt.attach(materialize(hits, "hits"), chunks, cols=("chunk_text", "source_file", "page_number"))
    return an.build_prompts(bench.select("item_id", "text"), ctx, "item_id", "text").select("item_id", "prompt")


def q_ask_batch(spark, sf_dir):
    """Every user turn of conversations answered from the document chunks."""
    conv = conversations(spark, sf_dir).filter(F.col("role") == "user")
    qs = conv.select(F.concat_ws("-", "conv_id", "turn").alias("question_id"), F.col("text").alias("question"))
    res = an.ask_batch(qs, corpus_chunks(spark, sf_dir))
    cited = F.transform("sources", lambda s: F.concat_ws("|", s.source_file, s.page_number.cast("string"), s.chunk_text))
    return res.select("question_id", "answer", "language", "detected_language", "disclaimer",
                      cited.alias("sources"), "reason")


# ---------------------------------------------------------------------------
# streaming sync
# ---------------------------------------------------------------------------

ARRIVING_BYTES = 32 << 20     # documents in an arriving file or a bucket, beyond the least numbers


def q_stream_sync(spark, sf_dir):
    """Index built from the 350/90 chunking; then the 400/100 chunking arrives as
    files, with a delete for each old key it lacks, and is applied batch by batch."""
    import uuid

    from quire.session import checkpoint_dir
    from quire.streaming.sync import stream_sync, write_bucketed
    new, old = _snapshots(spark, sf_dir)
    root = f"{checkpoint_dir(spark)}/stream_sync/{uuid.uuid4().hex}"
    key, values = ["doc_id", "chunk_index"], ["chunk_text"]
    pieces = _stored_pieces(spark, sf_dir, "documents", ARRIVING_BYTES)
    files, buckets = max(4, pieces), max(8, pieces)
    write_bucketed(old, f"{root}/target", key, buckets)
    gone = old.join(new, key, "left_anti").select(*key, F.lit(None).cast("string").alias("chunk_text"),
                                                  F.lit(True).alias("deleted"))
    arriving = new.withColumn("deleted", F.lit(False)).unionByName(gone)
    arriving.repartition(files, "doc_id").write.parquet(f"{root}/incoming")
    schema = spark.read.parquet(f"{root}/incoming").schema
    return stream_sync(spark, f"{root}/incoming", f"{root}/target", schema, key, values,
                       f"{root}/progress", buckets=buckets, max_files_per_trigger=-(-files // 2), deleted_col="deleted")


def q_knn_lsh(spark, sf_dir):
    """Approximate 5 nearest neighbours of every embedding."""
    e = table(spark, sf_dir, "embeddings")
    hits = rt.knn_lsh(e.select("vec_id", F.col("embedding").alias("qvec")), e, 5, "vec_id", "vec_id",
                      exclude_self=True)
    return hits.select(F.col("qid").alias("query_vec_id"), F.col("iid").alias("vec_id"), "score", "rank")


def q_lsh_recall(spark, sf_dir):
    """J2 recall@5 against the exact J1 neighbours, and the pairs scored for it."""
    from quire.session import store
    e = table(spark, sf_dir, "embeddings")
    q = e.select("vec_id", F.col("embedding").alias("qvec"))
    pairs = rt.lsh_pairs(q, e, "vec_id", "vec_id", exclude_self=True, as_rows=False)
    scored = store(rt.score_pairs(pairs, q, e, "vec_id", "vec_id", k=5), "lsh_scored")
    approx = rt._merge(scored.where("pairs is null").drop("pairs"), 5)
    exact = rt.knn(q, e, 5, "vec_id", "vec_id", exclude_self=True)
    n = e.agg(F.count(F.lit(1)).alias("n")).scalar()
    pairs_scored = scored.agg(F.coalesce(F.sum("pairs"), F.lit(0)).alias("n")).scalar()
    return rt.recall_at_k(approx, exact).withColumn("pairs_scored", pairs_scored).withColumn(
        "share_of_all_pairs", F.round(pairs_scored / (n * (n - 1)), 6))


# ---------------------------------------------------------------------------
# records, reports, checks
# ---------------------------------------------------------------------------

CUSTOMER_ROLES = {"name": ["name", "c_name"], "segment": ["mktsegment", "c_mktsegment"],
                  "balance": ["acctbal", "c_acctbal"], "missing": ["no_such_column"]}
CUSTOMER_LABELS = {"name": "Name", "segment": "Segment", "balance": "Balance", "missing": "Missing"}


def q_labelled_records(spark, sf_dir):
    """Customer rows as labelled records through role synonyms."""
    cust = table(spark, sf_dir, "customer").withColumn("source_file", F.lit("customer.csv"))
    recs = ch.csv_records(cust, "source_file", CUSTOMER_ROLES, CUSTOMER_LABELS, key="c_custkey")
    return recs.select("row_id", "raw_text", "source_type", "source_file")


def q_source_counts_sql(spark, sf_dir):
    """A3/O1: chunks per source file as SQL text over a temp view."""
    import uuid
    name = f"chunks_{uuid.uuid4().hex[:8]}"
    q_build_chunks(spark, sf_dir).createOrReplaceTempView(name)
    return spark.sql(f"SELECT source_file, COUNT(*) AS n_rows, CAST(AVG(LENGTH(chunk_text)) AS DOUBLE) AS avg_len "
                     f"FROM {name} GROUP BY source_file ORDER BY source_file")


def q_embedding_check(spark, sf_dir):
    """Vectors with the wrong dimension or null/NaN elements."""
    from quire.functions.vectors import check_dim
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    full = lambda x: F.array_repeat(F.lit(x).cast("float"), 64)
    kind = F.col("kind")
    faults = spark.createDataFrame(fx.VECTORS, "vec_id long, kind string").select(
        "vec_id", F.when(kind == "short", F.array_repeat(F.lit(1.0).cast("float"), 3))
        .when(kind == "inf", full(float("inf"))).when(kind == "-inf", full(float("-inf")))
        .when(kind == "nan", full(float("nan"))).when(kind == "hole", full(None)).alias("embedding"))
    good, bad = check_dim(e.unionByName(faults), 64)
    return good.select("vec_id", F.lit(None).cast("string").alias("reason")).unionByName(bad.select("vec_id", "reason"))


def q_staging_to_processed(spark, sf_dir):
    """S9 fallback / C5: staging chunks (JSON metadata) -> central schema."""
    return ch.staging_to_processed(q_staging_chunks(spark, sf_dir))


def q_preview(spark, sf_dir):
    """O2: stable 20-row preview of the chunk table."""
    return ch.preview(q_build_chunks(spark, sf_dir).select("chunk_id", "chunk_index", "source_file"), 20,
                      ["chunk_id"])



def q_extract_pages(spark, sf_dir):
    """The per-file extractor chain (Python plug-ins inside tasks) over
    every page's bytes; failures would be rows with ``error`` set."""
    p = pages_table(spark, sf_dir).select(F.col("url").alias("source_file"), F.col("html").cast("binary").alias("content"))
    broken = spark.createDataFrame([("broken.bin", b"\xff\xfe\xfa"), ("two pages.txt", b"one\ftwo")],
                                   "source_file string, content binary")
    pages = pg.extract_pages(p.unionByName(broken), [("html", pg.html_only), ("text", pg.text_extractor)])
    return pages.select("source_file", "page_number", "page_text", "extractor", F.col("error").isNotNull().alias("failed"))


def q_translation_messages(spark, sf_dir):
    """L4: chat messages that ask a model to put each user turn into Telugu
    (from the detected language)."""
    from quire.functions.language import translate_messages
    c = conversations(spark, sf_dir).filter(F.col("role") == "user")
    src = language_name(detect_language("text"))
    msgs = translate_messages(F.col("text"), src, F.lit("Telugu"))
    return c.select("conv_id", "turn", F.to_json(msgs, {"ignoreNullFields": "false"}).alias("messages"))


# ---------------------------------------------------------------------------
# lookups, labels, several pages per document, the build from files
# ---------------------------------------------------------------------------

def q_language_lookup(spark, sf_dir):
    """L2/L3: every language code of the documents and the literal ones, resolved."""
    from quire.functions.language import resolve_language
    d = table(spark, sf_dir, "documents").select("lang").distinct()
    d = d.unionByName(spark.createDataFrame([(x,) for x in fx.LANGUAGES], "lang string"))
    return d.withColumn("code", resolve_language("lang")).withColumn("name", language_name("code"))


def q_citations(spark, sf_dir):
    """Labels with all parts, without a page, without a score."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    page = F.when(F.col("doc_id") % 3 != 0, (F.col("doc_id") % 50).cast("int"))
    score = F.when(F.col("doc_id") % 5 != 0, F.col("n_chars") / 8.0)
    return d.select("doc_id", tx.citation_label("source", page, score).alias("label"))


def q_score_names(spark, sf_dir):
    """M3: the first score column present in a row, under one name."""
    d = table(spark, sf_dir, "documents")
    d = d.select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("n_chars").cast("double")).alias("_score"),
                 (F.col("n_chars") / 2.0).alias("similarity_score"))
    return rt.normalise_score(d)


def q_site_documents(spark, sf_dir):
    """S7/O5/A6 with several pages per document: the pages of one path language of a
    host in page order."""
    p = pages_table(spark, sf_dir)
    site = F.regexp_extract("url", r"^https?://([^/?#]+/[^/?#]*)", 1)
    rows = p.select(site.alias("site"), F.col("page_id").alias("page_number"), pg.html_text("html").alias("page_text"))
    return pg.assemble_documents(rows, "site", "page_number", "page_text")


PAGES_PER_FILE = 100


def q_file_build(spark, sf_dir):
    """The build from files (S1-S5, S8, P1, P3-P5, P12, U1-U4, A5): customers as CSV files
    with two header orders, in nested folders, and documents as text files of several
    pages, written below the checkpoint folder and then discovered, read, chunked."""
    import uuid

    from quire.plans.corpus import build_corpus
    from quire.session import checkpoint_dir, materialize
    root = f"{checkpoint_dir(spark)}/file_build/{uuid.uuid4().hex}"
    cust = table(spark, sf_dir, "customer").select(
        "c_custkey", F.col("c_name").alias("Disease"), F.col("c_mktsegment").alias("food"),
        F.col("c_acctbal").cast("string").alias("remedy"))
    even = F.col("c_custkey") % 2 == 0
    csv = {"header": "true", "escape": '"'}
    cust.where(even).select("Disease", "food", "remedy").write.options(**csv).csv(f"{root}/csv")
    cust.where(~even).select("remedy", "Disease", "food").write.options(**csv).csv(f"{root}/csv/more/deep")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    files = docs.groupBy(F.floor(F.col("doc_id") / PAGES_PER_FILE).alias("file")).agg(      # PAGES_PER_FILE rows a group
        F.array_sort(F.collect_list(F.struct("doc_id", "text"))).alias("pages"))
    text = F.array_join(F.transform("pages", lambda p: p.text), "\f").alias("value")
    files.select("file", text).write.partitionBy("file").option("lineSep", "\f").text(f"{root}/pages")
    chunks, failed = build_corpus(spark, root)
    named = F.regexp_replace("chunk_text", r"Source File: [^ |]+", "Source File: F")
    named = F.regexp_replace(named, r"^Source File: F \| Page", "Page")
    out = chunks.select("source_type", "page_number", "chunk_index", named.alias("chunk_text"))
    return materialize(out.unionByName(failed.select(
        F.lit("failed").alias("source_type"), F.lit(None).cast("int").alias("page_number"),
        F.lit(None).cast("int").alias("chunk_index"), F.col("error").alias("chunk_text"))), "file_build")


# ---------------------------------------------------------------------------
# stored indexes: cells, filtered lists, versions, late files, sketches; plug-ins
# ---------------------------------------------------------------------------

CELL_SHARE = 0.4        # cells probed; the given vectors are nearly random


def q_knn_cells(spark, sf_dir):
    """Approximate 5 nearest neighbours of every embedding, from k-means cells."""
    from quire.operators.cells import build_cells, search_cells
    e = table(spark, sf_dir, "embeddings")
    index = build_cells(e, "vec_id")
    q = e.select("vec_id", F.col("embedding").alias("qvec"))
    hits = search_cells(index, q, 5, "vec_id", probes=int(CELL_SHARE * len(index.centroids)), exclude_self=True)
    return hits.select(F.col("qid").alias("query_vec_id"), F.col("iid").alias("vec_id"), "score", "rank")


def q_bm25_postings(spark, sf_dir):
    """As ``bm25``, from stored inverted lists."""
    from quire.operators.postings import build_postings
    chunks = corpus_chunks(spark, sf_dir)
    hits = rt.bm25(table(spark, sf_dir, "benchmark"), build_postings(chunks, "chunk_id", "chunk_text"), RETRIEVAL_K, "item_id",
                   "text", "chunk_id", "chunk_text")
    return hits.select(F.col("qid").alias("item_id"), F.col("iid").alias("chunk_id"), "score", "rank")


def q_bm25_filtered(spark, sf_dir):
    """Benchmark questions that each ask for French or for German documents only;
    the lists of other languages are not read."""
    from quire.operators.postings import build_postings
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    asked = table(spark, sf_dir, "benchmark").withColumn("only", F.when(F.col("item_id") % 2 == 0, "fr").otherwise("de"))
    hits = rt.bm25(asked, build_postings(docs, "doc_id", "text", "lang"), RETRIEVAL_K, "item_id", "text", "doc_id", "text",
                   query_filter="only")
    return hits.select(F.col("qid").alias("item_id"), F.col("iid").alias("doc_id"), "score", "rank")


def _refreshed(spark, sf_dir):
    """A stored index of the 350/90 chunks, refreshed from a source in which every 50th
    document is gone and the one after it is chunked anew: (path, schema, key, values)."""
    import uuid

    from quire.session import checkpoint_dir
    new, old = _snapshots(spark, sf_dir)
    path = f"{checkpoint_dir(spark)}/index/{uuid.uuid4().hex}"
    key, values = ["doc_id", "chunk_index"], ["chunk_text"]
    ix.create_index(old, path, key, values)
    source = old.where("doc_id % 50 > 1").unionByName(new.where("doc_id % 50 = 1"))
    ix.refresh_index(source, path, key, values)
    return path, old.schema, key, values


def q_index_refresh(spark, sf_dir):
    """The new snapshot of a refreshed index."""
    return ix.read_index(spark, *_refreshed(spark, sf_dir))


def q_index_change_log(spark, sf_dir):
    """What the refresh logged."""
    path, schema, key, _ = _refreshed(spark, sf_dir)
    return ix.change_log(spark, path, schema, key)


def q_stream_late(spark, sf_dir):
    """R1 with files out of order: the 400/100 chunks and deletes of order 2 arrive first,
    the 350/90 chunks of order 1 after them, in a later run of the same stream."""
    import uuid

    from quire.session import checkpoint_dir, shuffles_dropped
    from quire.streaming.sync import stream_sync
    new, old = _snapshots(spark, sf_dir)
    root = f"{checkpoint_dir(spark)}/stream_late/{uuid.uuid4().hex}"
    key, values = ["doc_id", "chunk_index"], ["chunk_text"]
    pieces = _stored_pieces(spark, sf_dir, "documents", ARRIVING_BYTES)
    files = max(2, pieces)
    gone = old.join(new, key, "left_anti").select(*key, F.lit(None).cast("string").alias("chunk_text"))
    # dealt as documents, which are smaller than their overlapping chunks
    dealt = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet").select("doc_id", "text").repartition(files, "doc_id")
    new, old = _snapshots(spark, sf_dir, dealt)
    newest = new.withColumn("deleted", F.lit(False)).unionByName(gone.withColumn("deleted", F.lit(True)).repartition(files, "doc_id"))
    newest = newest.withColumn("seq", F.lit(2))
    late = old.withColumn("deleted", F.lit(False)).withColumn("seq", F.lit(1))
    for rows in (newest, late):
        with shuffles_dropped(spark):
            rows.write.mode("append").option("compression", "zstd").parquet(f"{root}/incoming")
        schema = spark.read.parquet(f"{root}/incoming").schema
        out = stream_sync(spark, f"{root}/incoming", f"{root}/target", schema, key, values, f"{root}/progress", buckets=max(8, pieces),
                          deleted_col="deleted", order_col="seq")
    return out


def q_length_report(spark, sf_dir):
    """A2 from stored sketches: the chunks of two snapshots' halves, merged by source."""
    from quire.operators.stats import length_sketches, merge_length_sketches
    from quire.session import materialize
    chunks = q_build_chunks(spark, sf_dir).select("source_file", "chunk_index", "chunk_text")
    half = F.col("chunk_index") % 2 == 0
    stored = materialize(length_sketches(chunks.where(half), "source_file", "chunk_text").unionByName(
        length_sketches(chunks.where(~half), "source_file", "chunk_text")), "sketches")
    return merge_length_sketches(stored, "source_file")


def q_length_report_sql(spark, sf_dir):
    """A3: the length report of the whole chunk table as SQL text over a temp view."""
    import uuid
    name = f"chunks_{uuid.uuid4().hex[:8]}"
    q_build_chunks(spark, sf_dir).createOrReplaceTempView(name)
    return spark.sql(f"SELECT MAX(LENGTH(chunk_text)) AS max_len, MIN(LENGTH(chunk_text)) AS min_len, "
                     f"CAST(AVG(LENGTH(chunk_text)) AS DOUBLE) AS avg_len FROM {name}")


def marking_translator(texts, sources, targets):
    """A stand-in for a translation model: a mark for the target language, one known text."""
    return ["chest pain today" if t == "سلام" else f"{t} ?" if target == "English" else f"[{target}] {t}"
            for t, target in zip(texts, targets)]


def hashing_generator(system, prompts):
    """A stand-in for a language model: the digest of the prompt it was given."""
    import hashlib
    return [hashlib.sha256(p.encode()).hexdigest() for p in prompts]


def q_ask_plugins(spark, sf_dir):
    """G5 with both model plug-ins (L5, L6 on the translated question, G2)."""
    conv = conversations(spark, sf_dir).filter(F.col("role") == "user")
    qs = conv.select(F.concat_ws("-", "conv_id", "turn").alias("question_id"), F.col("text").alias("question"))
    res = an.ask_batch(qs, corpus_chunks(spark, sf_dir), translate=marking_translator, generate=hashing_generator)
    return res.select("question_id", "answer", "language", F.size("sources").alias("n_sources"), "reason")


# ---------------------------------------------------------------------------
# stored tables: chunks by id, pages of split files, snapshots in a namespace
# ---------------------------------------------------------------------------

def q_hit_passages(spark, sf_dir):
    """Keyword hits of every benchmark question with the fields of their chunks, from a
    chunk table stored by id."""
    from quire.operators.passages import store_chunks
    from quire.session import materialize
    chunks = corpus_chunks(spark, sf_dir)
    hits = materialize(rt.bm25(table(spark, sf_dir, "benchmark"), chunks.select("chunk_id", "chunk_text"), RETRIEVAL_K,
                               "item_id", "text", "chunk_id", "chunk_text"), "hits")
    out = rt.attach(hits, store_chunks(chunks), cols=("chunk_text", "source_file"))
    return out.select(F.col("qid").alias("item_id"), F.col("iid").alias("chunk_id"), "rank", "chunk_text", "source_file")


def q_text_pages(spark, sf_dir):
    """Documents as pages of text files below the checkpoint folder, one page in
    their order as a row, files read in splits."""
    import uuid

    from quire.session import checkpoint_dir
    from quire.sources.files import require_files
    root = f"{checkpoint_dir(spark)}/text_pages/{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("value"))
    docs = docs.withColumn("file", F.floor(F.col("doc_id") / PAGES_PER_FILE))
    (docs.repartition("file").sortWithinPartitions("file", "doc_id").select("file", "value").write
     .partitionBy("file").option("lineSep", "\f").text(root))
    require_files(spark, root, "txt")
    pages = pg.text_pages(spark, root)
    name = F.regexp_extract("source_path", r"file=(\d+)", 1).cast("long")
    return pages.select(name.alias("file"), "page_number", "page_text", F.col("error").isNotNull().alias("failed"))


def q_stored_tables(spark, sf_dir):
    """Two chunk tables written as snapshots into a
    namespace, one of them without ``source_type`` and one over an older schema, checked,
    loaded, united by name; a missing kind comes from the file name."""
    import uuid

    from quire.session import checkpoint_dir, materialize
    from quire.sources import files as fl
    space = f"quire_{uuid.uuid4().hex}"
    root = f"{checkpoint_dir(spark)}/stored_tables/{space}"
    fl.ensure_namespace(spark, space, root)
    untyped = q_build_chunks(spark, sf_dir).drop("source_type").withColumn(
        "source_file", F.concat(F.coalesce("source_file", F.lit("none")), F.lit(".PDF")))
    typed = q_staging_to_processed(spark, sf_dir)
    fl.write_snapshot(typed.select("chunk_id", F.lit(1).alias("old_column")), f"{space}.records", path=f"{root}/records")
    fl.write_snapshot(typed, f"{space}.records", partition_by=["source_type"], path=f"{root}/records")
    fl.write_snapshot(untyped, f"{space}.texts", path=f"{root}/texts")
    need = ["chunk_id", "chunk_index", "chunk_text", "source_file"]
    parts = [fl.load_checked(spark, f"{space}.texts", need), fl.load_checked(spark, f"{space}.records", need),
             fl.table_or_fallback(spark, f"{space}.pages", lambda: typed.limit(0))]
    kind = F.coalesce("source_type", ch.source_kind("source_file"))
    out = materialize(ch.union_all(parts).select("chunk_id", "chunk_index", "source_file", kind.alias("source_type")), space)
    spark.sql(f"DROP DATABASE {space} CASCADE")
    return out
