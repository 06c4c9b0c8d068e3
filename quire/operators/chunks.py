"""Record -> chunk operators.

Everything here is narrow: no shuffle between the record scan and the chunk
write, so the build path scales with the number of input splits.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions import text as tx
from quire.functions.chunking import check_chunk_params, chunk_sentences, chunk_words

BASE_SCHEMA = T.StructType([
    T.StructField("row_id", T.StringType(), False),
    T.StructField("raw_text", T.StringType(), True),
    T.StructField("source_type", T.StringType(), False),
    T.StructField("source_file", T.StringType(), True),
    T.StructField("page_number", T.IntegerType(), True),
])

CHUNK_COLUMNS = ["row_id", "chunk_id", "chunk_index", "chunk_text", "source_type", "source_file", "page_number"]


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_base_records(df: DataFrame, text, source_type: str | Column, source_file=None,
                    page_number=None, key=None) -> DataFrame:
    """Base records with a content-derived, deterministic ``row_id``.

    ``row_id = sha2(source_type || source_file || page || key || raw_text)``;
    pass ``key`` when identical texts of one file must stay distinct rows.
    """
    st = F.lit(source_type) if isinstance(source_type, str) else source_type
    sf = _c(source_file).cast("string") if source_file is not None else F.lit(None).cast("string")
    pg = _c(page_number).cast("int") if page_number is not None else F.lit(None).cast("int")
    k = _c(key).cast("string") if key is not None else F.lit(None).cast("string")
    raw = _c(text).cast("string")
    return df.select(
        tx.hash_id(st, sf, pg, k, raw).alias("row_id"),
        raw.alias("raw_text"),
        st.alias("source_type"),
        sf.alias("source_file"),
        pg.alias("page_number"),
    )


def empty_base(spark) -> DataFrame:
    """An empty frame with the base-record schema."""
    return spark.createDataFrame([], BASE_SCHEMA)


def union_all(frames: list[DataFrame]) -> DataFrame:
    """Union by name, missing columns become null."""
    return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def quality_columns(c) -> list[Column]:
    """P8-P10 measurements for a text column."""
    return [
        tx.word_count(c).alias("word_count"),
        tx.alpha_ratio(c).alias("alpha_ratio"),
        tx.is_boilerplate(c).alias("is_boilerplate"),
    ]


def passes_gates(c, min_words: int = 10, min_alpha: float = 0.2) -> Column:
    """At least ``min_words`` words, Latin-letter ratio >= ``min_alpha``,
    not a heading-only text."""
    return (tx.word_count(c) >= min_words) & (tx.alpha_ratio(c) >= min_alpha) & ~tx.is_boilerplate(c)


def build_chunks(base: DataFrame, size: int = 350, overlap: int = 90, min_words: int = 10,
                 min_alpha: float = 0.2, strategy: str = "words") -> DataFrame:
    """Base records -> processed chunks (central schema, section 1.3).

    clean (T1) -> chunk (C1 on the clean text, or C2 on the raw text) ->
    posexplode (C4) -> drop blank (P7) -> gates (P8-P10) -> chunk_id (T8).
    Blank text yields no chunks; chunks are joined from clean words, so they
    are already T1-clean. No shuffle anywhere.
    """
    if strategy == "words":
        chunk = chunk_words(F.col("_clean"), size, overlap, cleaned=True)
    else:
        # the sentence chunker sees the raw text, so blank-line paragraphs
        # still separate units (D6); its chunks come out clean
        chunk = chunk_sentences(F.col("raw_text"), size, overlap)
    cleaned = base.withColumn("_clean", tx.clean_text("raw_text"))
    exploded = cleaned.select(
        "row_id", "source_type", "source_file", "page_number",
        F.posexplode(chunk).alias("chunk_index", "chunk_text"),
    ).filter(F.col("chunk_text") != "")
    t = F.col("chunk_text")
    gated = exploded.filter((tx.clean_word_count(t) >= min_words) & (tx.clean_alpha_ratio(t) >= min_alpha)
                            & ~tx.is_boilerplate(t))
    return gated.select(
        "row_id",
        tx.hash_id("row_id", F.col("chunk_index").cast("int"), "chunk_text").alias("chunk_id"),
        F.col("chunk_index").cast("int").alias("chunk_index"),
        "chunk_text",
        "source_type",
        "source_file",
        F.col("page_number").cast("int").alias("page_number"),
    )


def staging_chunks(df: DataFrame, text, file_col, source_type: str, record_type: str,
                   size: int = 350, overlap: int = 70, extra_meta: dict | None = None) -> DataFrame:
    """C4/C5/T8 staging form: (id, text_chunk, source_type, metadata JSON).

    The text is sentence-chunked (C2); ``id = sha2(file || index || chunk)``
    with a null file written as ``unknown_file``; ``metadata`` is
    ``{"file_name", [extra...], "record_type", "chunk_index"}`` as JSON.
    Sizes that can't work are refused (C3).
    """
    check_chunk_params(size, overlap)
    extra_meta = extra_meta or {}
    exploded = df.select(
        _c(file_col).alias("_file"),
        *[_c(v).alias(k) for k, v in extra_meta.items()],
        F.posexplode(chunk_sentences(_c(text), size, overlap)).alias("_idx", "text_chunk"),
    ).filter(F.length("text_chunk") > 0)
    meta = F.to_json(F.struct(
        F.col("_file").alias("file_name"),
        *[F.col(k) for k in extra_meta],
        F.lit(record_type).alias("record_type"),
        F.col("_idx").alias("chunk_index"),
    ))
    return exploded.select(
        F.sha2(F.concat_ws(tx.ID_SEP, F.coalesce(F.col("_file"), F.lit(tx.UNKNOWN_FILE)),
                           F.col("_idx").cast("string"), F.col("text_chunk")), 256).alias("id"),
        "text_chunk",
        F.lit(source_type).alias("source_type"),
        meta.alias("metadata"),
    )


# Fixed value: fields of the staging metadata.
STAGING_META_DDL = "file_name string, page_count int, record_type string, chunk_index int"


def staging_to_processed(staging: DataFrame) -> DataFrame:
    """S9 fallback: staging chunks -> central schema by parsing ``metadata``."""
    m = F.from_json("metadata", STAGING_META_DDL)
    return staging.select(
        tx.hash_id(F.col("source_type"), m["file_name"], m["chunk_index"], F.col("text_chunk")).alias("row_id"),
        F.col("id").alias("chunk_id"),
        m["chunk_index"].alias("chunk_index"),
        F.col("text_chunk").alias("chunk_text"),
        "source_type",
        m["file_name"].alias("source_file"),
        F.lit(None).cast("int").alias("page_number"),
    )


# ---------------------------------------------------------------------------
# CSV records -> labelled base records
# ---------------------------------------------------------------------------

# Header synonyms per role (first present wins) and the label
# each role gets in the record text, in output order.
ROLE_SYNONYMS = {
    "condition": ["condition", "disease", "ailment", "problem"],
    "diet": ["diet", "diet_recommendation", "food", "ahara"],
    "yoga": ["yoga", "asana", "exercise", "lifestyle"],
    "medical": ["medical", "medicine", "treatment", "remedy"],
    "prevention": ["prevention", "preventive", "care", "tips"],
    "prognosis": ["prognosis", "outlook", "recovery"],
}
ROLE_LABELS = {"condition": "Condition", "diet": "Diet", "yoga": "Yoga", "medical": "Medical",
               "prevention": "Prevention", "prognosis": "Prognosis"}


def resolve_columns(columns: list[str], synonyms: dict[str, list[str]] = ROLE_SYNONYMS) -> dict[str, str | None]:
    """Role -> the actual column of the first synonym present among the
    headers (compared trimmed and lower-cased), or None. Schema-time only."""
    lookup = {c.strip().lower(): c for c in columns}
    return {role: next((lookup[s] for s in cands if s in lookup), None) for role, cands in synonyms.items()}


def role_column(col: str | None) -> Column:
    """The column as string, or a typed null for a missing role."""
    return F.col(col).cast("string") if col else F.lit(None).cast("string")


def csv_records(df: DataFrame, source_file_col: str = "source_file", synonyms=ROLE_SYNONYMS,
                labels=ROLE_LABELS, source_type: str = "csv", key: str | None = None) -> DataFrame:
    """P5: CSV rows -> base records with ``Source: csv | Role: value | ... |
    Source File: f`` text; blank roles are left out."""
    roles = resolve_columns(df.columns, synonyms)
    text = tx.labelled_text([(labels[r], role_column(roles[r])) for r in synonyms],
                            head=F.lit(f"Source: {source_type}"),
                            tail=F.concat(F.lit("Source File: "),
                                          F.coalesce(F.col(source_file_col), F.lit(tx.UNKNOWN_FILE))))
    return to_base_records(df.withColumn("_text", text), "_text", source_type, source_file=source_file_col,
                           key=key)


def source_kind(file_col) -> Column:
    """P12: 'csv' / 'pdf' from a file name (prefix or extension) for chunk
    tables that lack source_type."""
    f = F.lower(_c(file_col))
    return (F.when(f.startswith("csv") | f.endswith(".csv"), F.lit("csv"))
            .when(f.startswith("pdf") | f.endswith(".pdf"), F.lit("pdf")))


def preview(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    """O2: a stable preview - ordered, then limited (TakeOrderedAndProject)."""
    return df.orderBy(*order).limit(n)
