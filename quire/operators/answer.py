"""Batch question answering.

``ask_batch`` answers a table of questions: each stage is a column or a join
over all questions. Only the model plug-ins (translator, generator) run in
Python, in Arrow batches, and rows that need no model (English text, flagged
or rejected questions) never reach them.
"""

from __future__ import annotations

import functools
from typing import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions.language import ENGLISH, detect_language, language_name, resolve_language
from quire.functions.text import _c, red_flag
from quire.functions.vectors import HashingEncoder, check_dim, embed
from quire.operators import retrieval as rt
from quire.operators.passages import ChunkStore
from quire.operators.rules import MAX_TOP_K, validate_questions
from quire.session import forget, materialize, store

# Default wording of the fixed texts (our own; each is an argument of
# ``ask_batch``). The prompt layout around them - "Context:", the
# "[Source: f, Page: n] text" entries, "Question:" - is a fixed format.
MEDICAL_DISCLAIMER = (
    "This answer is drawn from the indexed texts on traditional practice and is "
    "general information only, not medical advice; please see a qualified "
    "practitioner before making health decisions."
)
SYSTEM_PROMPT = (
    "Answer from the context passages only and cite each claim as "
    "[source_file, page]. When the passages do not cover the question, say "
    "that plainly rather than guessing. Present remedies as traditional "
    "guidance, never as a diagnosis, prescription or dosage, and suggest "
    "consulting a qualified practitioner for personal decisions."
)
RED_FLAG_MESSAGE = (
    "Some of the symptoms you describe can be an emergency. Please contact "
    "emergency services or a doctor right away; this assistant cannot help "
    "with urgent care."
)
NO_CONTEXT_MESSAGE = "The indexed sources contain nothing relevant to this question."
NO_CONTEXT_BLOCK = "(no context)"
PROMPT_TAIL = ("Reply in three to six sentences, use only the context above, and cite "
               "sources inline as [source_file, page].")

SOURCE_TYPE = T.StructType([
    T.StructField("chunk_text", T.StringType()), T.StructField("source_file", T.StringType()),
    T.StructField("page_number", T.IntegerType()), T.StructField("score", T.DoubleType()),
])


# ---------------------------------------------------------------------------
# prompts (G1)
# ---------------------------------------------------------------------------

def context_entry(source_file, page_number, chunk_text) -> Column:
    """``[Source: f, Page: n] text``; a null page prints as ``None``."""
    return F.concat(F.lit("[Source: "), F.coalesce(_c(source_file), F.lit("unknown")), F.lit(", Page: "),
                    F.coalesce(_c(page_number).cast("string"), F.lit("None")), F.lit("] "),
                    F.coalesce(_c(chunk_text), F.lit("")))


def user_prompt(question, context_block, tail: str = PROMPT_TAIL) -> Column:
    """G1: the user message around a context block ('(no context)' if blank)."""
    block = F.when(F.coalesce(_c(context_block), F.lit("")) == "", F.lit(NO_CONTEXT_BLOCK)).otherwise(
        _c(context_block))
    return F.concat(F.lit("Context:\n"), block, F.lit("\n\nQuestion: "), _c(question), F.lit("\n\n"),
                    F.lit(tail))


def build_prompts(questions: DataFrame, hits: DataFrame | str, qid: str, question: str,
                  rank_col: str = "rank", tail: str = PROMPT_TAIL) -> DataFrame:
    """G1: one prompt per question from its ranked hits (qid, rank,
    chunk_text, source_file, page_number), or from the questions' own column of that name, an
    array of them in order; questions without hits get
    '(no context)'. The collect per question is bounded by top_k."""
    def entry(s):
        return context_entry(s["source_file"], s["page_number"], s["chunk_text"])

    if isinstance(hits, str):
        block = F.array_join(F.transform(F.col(hits), entry), "\n\n")
        return questions.withColumn("prompt", user_prompt(question, F.coalesce(block, F.lit("")), tail))
    per_q = (hits.groupBy(F.col("qid").alias(qid))
             .agg(F.array_sort(F.collect_list(F.struct(
                 F.col(rank_col).alias("r"), context_entry("source_file", "page_number", "chunk_text").alias("e"))))
                 .alias("_ctx")))
    block = F.array_join(F.transform("_ctx", lambda s: s["e"]), "\n\n")
    return (questions.join(per_q, qid, "left")
            .withColumn("prompt", user_prompt(question, F.coalesce(block, F.lit("")), tail))
            .drop("_ctx"))


# ---------------------------------------------------------------------------
# model plug-ins (G2, L5): Arrow-batched, Python only here
# ---------------------------------------------------------------------------

# A plug-in gets whole batches: lists of equal length in, a list of that length out.
Translate = Callable[[list[str], list[str], list[str]], list[str]]   # (texts, source names, target names)
Generate = Callable[[str, list[str]], list[str]]                     # (system prompt, user prompts)


def _by_batch(call, *columns: list) -> tuple[list, list]:
    """(results, errors) of a plug-in over a batch. If the batch fails it is called row
    by row, so a failure affects its own row only."""
    if not columns[0]:
        return [], []
    try:
        out = list(call(*columns))
        if len(out) != len(columns[0]):
            raise ValueError(f"plug-in returned {len(out)} results for {len(columns[0])} rows")
        return out, [None] * len(out)
    except Exception as whole:  # noqa: BLE001 - kept in the row
        if len(columns[0]) == 1:
            return [None], [f"{type(whole).__name__}: {whole}"]
    rows = [_by_batch(call, *([c[i]] for c in columns)) for i in range(len(columns[0]))]
    return [r[0][0] for r in rows], [r[1][0] for r in rows]


def extractive_answer(sources, no_context: str = NO_CONTEXT_MESSAGE) -> Column:
    """Built-in generator, in the JVM: the first sentence of each source (an array of
    structs with chunk_text, source_file, page_number) with its citation."""
    def cited(s):
        first = F.regexp_replace(F.trim(F.element_at(F.split(F.coalesce(s.chunk_text, F.lit("")), r"\. "), 1)), r"\.+$", "")
        return F.when(first != "", F.concat(
            first, F.lit(". ["), F.coalesce(s.source_file, F.lit("unknown")), F.lit(", "),
            F.coalesce(s.page_number.cast("string"), F.lit("None")), F.lit("]")))

    text = F.array_join(F.filter(F.transform(_c(sources), cited), lambda x: x.isNotNull()), " ")
    return F.when(F.coalesce(text, F.lit("")) == "", F.lit(no_context)).otherwise(text)


def translate_column(df: DataFrame, text: str, src_name: str, dst_name: str, out: str,
                     translate: Translate | None = None) -> DataFrame:
    """``out`` = translate(text) when text is non-blank and the languages differ, else
    the text itself (blank -> ''). Only rows that need the model are sent to it; a failed
    translation keeps the source text. Without a model nothing leaves the JVM."""
    keep_text = F.when(F.length(F.trim(F.coalesce(F.col(text), F.lit("")))) > 0, F.col(text)).otherwise(F.lit(""))
    if translate is None:
        return df.withColumn(out, keep_text)
    need = F.coalesce((F.length(F.trim(F.coalesce(F.col(text), F.lit("")))) > 0)
                      & (F.lower(F.col(src_name)) != F.lower(F.col(dst_name))), F.lit(False))
    marked = df.withColumn("_need", need)
    schema = T.StructType(marked.schema.fields + [T.StructField(out, T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got, errors = _by_batch(translate, *(b[c].tolist() for c in (text, src_name, dst_name)))
            b[out] = [t if e or g is None else g.strip() for t, g, e in zip(b[text], got, errors)]
            yield b

    via_model = marked.filter(F.col("_need")).mapInPandas(run, schema)
    passthrough = marked.filter(~F.col("_need")).withColumn(out, keep_text)
    return via_model.unionByName(passthrough).drop("_need")


def generate_column(df: DataFrame, prompt: str, out: str, generate: Generate, error: str,
                    system_prompt: str = SYSTEM_PROMPT) -> DataFrame:
    """``out`` = generate(system prompt, user prompts) in Arrow batches; a row whose
    generation fails has a null ``out`` and the failure in ``error``."""
    schema = T.StructType(df.schema.fields + [T.StructField(out, T.StringType()), T.StructField(error, T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b[out], b[error] = _by_batch(lambda p: generate(system_prompt, p), b[prompt].tolist())
            yield b

    return df.mapInPandas(run, schema)


# ---------------------------------------------------------------------------
# ask_batch
# ---------------------------------------------------------------------------

ROUND_BYTES = 32 << 20      # measured bytes of hits whose texts are looked up and compared at once


def _rounds(hits: DataFrame) -> list[DataFrame]:
    """``hits`` by question in parts of about ``ROUND_BYTES``."""
    n = -(-rt.measured_size(hits)[1] // ROUND_BYTES) or 1
    return [hits.where(F.pmod(F.xxhash64("qid"), F.lit(n)) == i) for i in range(n)] if n > 1 else [hits]


def _picked(hits: DataFrame, chunks: DataFrame | ChunkStore, lam: float) -> list[DataFrame]:
    """MMR of every question's hits, with the fields of the chunks taken, as stored tables. A
    round's candidates alone have their texts, which are shuffled once and dropped; those of
    the chunks taken are looked up again. A chunk id that occurs again gives equal rows."""
    parts = []
    for some in _rounds(hits):
        cands = rt.attach(some, chunks, cols=("chunk_text", "source_file", "page_number"))
        cands = cands.withColumn("_text", F.xxhash64("chunk_text"))
        taken = store(rt.mmr(cands, lam=lam, top_k_col="top_k", with_text=False), "taken")
        texts = rt.attach(taken, chunks, cols=("chunk_text",)).where(F.col("_text") == F.xxhash64("chunk_text"))
        parts.append(store(texts.drop("_text"), "picked"))
        forget(taken)
    return parts

def ask_batch(questions: DataFrame, chunks: DataFrame, qid: str = "question_id", question: str = "question",
              top_k: int | str = rt.TOP_K, language: str | None = None, source_filter: str | None = None,
              encoder=None, translate: Translate | None = None, generate: Generate | None = None,
              lam: float = rt.MMR_LAMBDA, texts: dict | None = None, keywords: rt.KeywordIndex | rt.Postings | None = None,
              on_rejected: Callable[[DataFrame], None] | None = None,
              passages: ChunkStore | None = None) -> DataFrame:
    """Answer every question of ``questions`` against ``chunks`` (central
    schema). Returns one row per row of ``questions`` (ids may repeat): qid, answer,
    language, detected_language, disclaimer, sources (array of struct, MMR order),
    reason (null unless the question was rejected or its generation failed).

    ``top_k`` is a number or the name of a column of numbers (1-20). ``texts``
    overrides the fixed wording: disclaimer, system_prompt, red_flag, no_context,
    prompt_tail. Without ``translate`` texts stay as they are; without ``generate``
    the answer is extractive; both defaults stay in the JVM. ``on_rejected`` is
    given the chunks whose stored vector is unusable (they are still found by
    keywords). ``keywords`` is an index of the chunks that batches share (``keyword_index``
    or ``build_postings``, with the chunks' ``source_type``); without it the batch's
    questions, which are many, are scored in cells over the chunks' terms. ``passages`` are the
    same chunks stored by id (``store_chunks``), from which the texts of hits are read."""
    encoder = encoder or HashingEncoder()
    tx_ = {"disclaimer": MEDICAL_DISCLAIMER, "system_prompt": SYSTEM_PROMPT, "red_flag": RED_FLAG_MESSAGE,
           "no_context": NO_CONTEXT_MESSAGE, "prompt_tail": PROMPT_TAIL, **(texts or {})}
    cols = [F.col(qid), F.col(question).alias("question")]
    cols.append(F.col(language).alias("language_req") if language else F.lit(None).cast("string").alias("language_req"))
    cols.append(F.col(source_filter).alias("source_filter") if source_filter
                else F.lit(None).cast("string").alias("source_filter"))
    cols.append((F.col(top_k) if isinstance(top_k, str) else F.lit(top_k)).cast("int").alias("top_k"))
    # a row is its own key from here on: written once, so the number is fixed
    numbered = materialize(questions.select(*cols).withColumn("_row", F.monotonically_increasing_id()), "asked")
    q = validate_questions(numbered, "question", top_k="top_k", source_filter="source_filter")
    rejected = q.filter(~F.col("is_valid"))

    detected = detect_language("question")
    target = F.when(F.coalesce(F.col("language_req"), F.lit("")) != "", resolve_language("language_req")) \
        .otherwise(detected)
    ok = (q.filter(F.col("is_valid"))
          .withColumn("detected_language", detected)
          .withColumn("language", target)
          .withColumn("detected_name", language_name("detected_language"))
          .withColumn("target_name", language_name("language"))
          .withColumn("english_name", F.lit(ENGLISH[1])))

    # Red flag on the original text, then on the English form
    flagged_1 = red_flag("question")
    ok = ok.withColumn("_flag1", flagged_1)
    ok = translate_column(ok.withColumn("_q_for_tr", F.when(~F.col("_flag1"), F.col("question"))),
                          "_q_for_tr", "detected_name", "english_name", "english_question", translate)
    ok = ok.withColumn("flagged", F.col("_flag1") | ((F.col("detected_language") != ENGLISH[0]) &
                                                     red_flag("english_question")))
    # questions-sized tables that feed several branches are written once
    ok = materialize(ok.drop("_q_for_tr"), "questions")
    clear = ok.filter(~F.col("flagged"))

    # M4: hybrid retrieval with the per-question source filter, then MMR
    depth = F.greatest(F.lit(rt.FETCH_K), 4 * F.col("top_k"))   # O3, per question
    fetch_k = rt.fetch_k_for(MAX_TOP_K if isinstance(top_k, str) else top_k)
    ch = chunks.select("chunk_id", "chunk_text", "source_file", "page_number", "source_type")
    if "embedding" in chunks.columns:
        # an embedded chunk table (E1 run once at build time) is used as is;
        # rows whose vector does not fit the encoder are left out
        cvec, unusable = check_dim(chunks.select("chunk_id", "source_type", "embedding"), encoder.dim)
        if on_rejected is not None:
            on_rejected(unusable)
    else:
        # written first: a task that embeds and scores holds two Python processes
        cvec = store(embed(ch.select("chunk_id", "chunk_text", "source_type"), "chunk_text", encoder).drop("chunk_text"), "vectors")
    asked = clear.select("_row", "english_question", "source_filter")
    # a question without a term has no direction: no vector hits
    qv = embed(asked, "english_question", encoder, "qvec").where(F.exists("qvec", lambda x: x != 0))
    vec_hits = rt.knn(qv, cvec, fetch_k, "_row", "chunk_id", query_filter="source_filter", item_type="source_type")
    depths = clear.select(F.col("_row").alias("qid"), "top_k", depth.alias("_depth"))

    def deep(hits: DataFrame, name: str) -> DataFrame:
        """Each list is written once, and the shuffle files of its making go, before the next one is
        made, so that the size check, the join and the MMR stage do not re-run retrieval."""
        return store(hits.join(depths, "qid").where("rank <= _depth").drop("_depth", "top_k"), name)

    vec_hits = deep(vec_hits, "vector-hits")
    if "embedding" not in chunks.columns:
        forget(cvec)
    own_index = keywords is None
    if own_index:
        keywords = rt.keyword_index(ch, "chunk_id", "chunk_text", "source_type")
    kw_hits = rt.bm25(asked, keywords, fetch_k, "_row", "english_question",
                      "chunk_id", "chunk_text", query_filter="source_filter", item_type="source_type")
    kw_hits = deep(kw_hits, "keyword-hits")
    if own_index:
        forget(keywords.toks, keywords.df)
    fused = rt.hybrid(vec_hits, kw_hits, fetch_k).join(depths, "qid").where("rank <= _depth").drop("_depth")
    fused = store(fused, "hits")
    forget(vec_hits, kw_hits)
    parts = _picked(fused, passages or ch, lam)
    picked = functools.reduce(DataFrame.unionByName, parts)

    # Prompt and answer for questions with context
    sources = (picked.groupBy(F.col("qid").alias("_row"))
               .agg(F.array_sort(F.array_distinct(F.collect_list(F.struct(
                   F.col("mmr_rank").alias("r"),
                   F.struct("chunk_text", "source_file", F.col("page_number").cast("int").alias("page_number"),
                            F.col("score").cast("double").alias("score")).alias("s"))))).alias("_src"))
               .select("_row", F.transform("_src", lambda x: x["s"]).alias("sources")))
    with_ctx = build_prompts(clear.join(sources, "_row", "left"), "sources", "_row", "english_question", tail=tx_["prompt_tail"])
    has_ctx = F.coalesce(F.size("sources"), F.lit(0)) > 0
    found = with_ctx.filter(has_ctx)
    if generate is None:
        gen = found.withColumn("english_answer", extractive_answer("sources", tx_["no_context"]))
    else:
        gen = generate_column(found, "prompt", "english_answer", generate, "failure", tx_["system_prompt"])
    no_ctx = with_ctx.filter(~has_ctx).withColumn("english_answer", F.lit(tx_["no_context"]))
    flagged = ok.filter(F.col("flagged")).withColumn("english_answer", F.lit(tx_["red_flag"])) \
        .withColumn("sources", F.array().cast(T.ArrayType(SOURCE_TYPE)))
    answered = store(gen.drop("prompt").unionByName(no_ctx.drop("prompt"), allowMissingColumns=True)
                     .unionByName(flagged, allowMissingColumns=True), "answered")
    forget(fused, *parts)
    if "failure" not in answered.columns:
        answered = answered.withColumn("failure", F.lit(None).cast("string"))

    # L5 back to the target language (G3: a failed translation keeps English)
    final = translate_column(answered, "english_answer", "english_name", "target_name", "answer", translate)
    failed = F.col("failure").isNotNull()
    out = final.select(
        qid, F.when(~failed, F.col("answer")).alias("answer"), "language", "detected_language", F.lit(tx_["disclaimer"]).alias("disclaimer"),
        F.coalesce(F.col("sources"), F.array().cast(T.ArrayType(SOURCE_TYPE))).alias("sources"),
        F.when(failed, F.concat(F.lit("generation failed: "), F.col("failure"))).alias("reason"))
    rej = rejected.select(
        qid, F.lit(None).cast("string").alias("answer"), F.lit(None).cast("string").alias("language"),
        F.lit(None).cast("string").alias("detected_language"), F.lit(None).cast("string").alias("disclaimer"),
        F.array().cast(T.ArrayType(SOURCE_TYPE)).alias("sources"), "reason")
    return out.unionByName(rej)
