import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.functions.chunking import check_chunk_params, chunk_sentences, chunk_words
from tests.conftest import SF_SMALL, one_col


def _chunks(spark, texts, fn, *args):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("t"), *args)).collect()]


def test_chunk_words_fixtures(spark):
    w = " ".join(f"w{i}" for i in range(1, 12))
    ten = " ".join(str(i) for i in range(10))
    out = _chunks(spark, [None, "  ", ten, w], chunk_words, 5, 2)
    assert out[0] == [] and out[1] == []
    assert out[2] == ["0 1 2 3 4", "3 4 5 6 7", "6 7 8 9"]
    assert out[3] == ["w1 w2 w3 w4 w5", "w4 w5 w6 w7 w8", "w7 w8 w9 w10 w11"]
    assert _chunks(spark, [ten], chunk_words, 10, 3)[0] == [ten]
    clamp = _chunks(spark, ["a b c d e f g"], chunk_words, 5, 9)[0]
    assert clamp == ["a b c d e", "b c d e f", "c d e f g"]


def test_chunk_sentences_fixtures(spark):
    out = _chunks(spark, ["A b c. D e f. G h i.", "A b.\n\nc d e f g h.", None], chunk_sentences, 6, 2)
    assert out[0] == ["A b c. D e f.", "e f. G h i."]
    assert out[2] == []
    out2 = _chunks(spark, ["A b.\n\nc d e f g h."], chunk_sentences, 5, 1)[0]
    assert out2 == ["A b.", "b. c d e f g", "g g h."]


@pytest.mark.parametrize("size,overlap", [(0, 0), (5, -1), (5, 5), (5, 6)])
def test_chunk_param_errors(size, overlap):
    with pytest.raises(ValueError):
        check_chunk_params(size, overlap)


# --- independent brute force for C2 (greedy packing over sentence units) ---

_SENT = re.compile(r"(?<=[.?!])\s+(?=[A-Z0-9\"'(])")


def brute_sentences(text, size, overlap):
    if text is None or not text.split():
        return []
    words = text.split()
    if len(words) <= size:
        return [" ".join(words)]
    units = []
    for para in re.split(r"\n\s*\n", text):
        for sent in _SENT.split(para.strip()):
            if sent.split():
                units.append(sent.split())
    out, cur = [], []
    for u in units:
        if len(u) > size:
            if cur:
                out.append(cur)
                cur = []
            start = 0
            while True:
                out.append(u[start:start + size])
                if start + size >= len(u):
                    break
                start += size - overlap
        elif len(cur) + len(u) <= size:
            cur = cur + u
        else:
            if cur:
                out.append(cur)
            cur = list(u)
    if cur:
        out.append(cur)
    res = [out[0]] + [(out[i - 1][-overlap:] if overlap else []) + out[i] for i in range(1, len(out))]
    return [" ".join(c) for c in res]


def test_chunk_sentences_matches_brute_force_on_documents(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").orderBy("doc_id")
    rows = docs.select("text", chunk_sentences(F.col("text"), 40, 10).alias("c")).collect()
    bad = [i for i, r in enumerate(rows) if r["c"] != brute_sentences(r["text"], 40, 10)]
    assert not bad, bad[:5]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.sampled_from(["Aa", "bb", "cc.", "Dd!", "ee?", "\n\n", "  ", "(f"]), max_size=60),
       st.integers(1, 8), st.integers(0, 7))
def test_chunk_properties(spark, toks, size, overlap):
    if overlap >= size:
        overlap = size - 1
    text = " ".join(toks)
    got = _chunks(spark, [text], chunk_sentences, size, overlap)[0]
    assert got == brute_sentences(text, size, overlap)
    assert all(len(c.split()) <= size + overlap for c in got)
    words = _chunks(spark, [text], chunk_words, size, overlap)[0]
    if text.split():
        assert words[0].split()[0] == text.split()[0] and words[-1].split()[-1] == text.split()[-1]


def test_words_and_pages_are_cleaned_once(spark):
    """One cleaning expression in the plan of a chunker or of a build from pages, so a text is cleaned once."""
    from pyspark.sql import functions as F

    from quire.functions.chunking import chunk_words
    from quire.functions.text import WS, clean_text
    from quire.operators.chunks import build_chunks, to_base_records
    from quire.sources.pages import page_records

    def cleanings(df):
        return df._jdf.queryExecution().optimizedPlan().toString().count(f"{WS}+,")

    d = spark.range(3).select("id", F.concat(F.lit(" a  b\n"), F.col("id").cast("string")).alias("t"))
    assert cleanings(d.select(clean_text("t").alias("c"))) == 1
    one = d.select(chunk_words("t", 2, 1).alias("c"))
    assert cleanings(one) == 1 and [r.c for r in one.collect()] == [["a b", f"b {i}"] for i in range(3)]
    pages = d.select(F.lit("f").alias("source_file"), F.col("id").cast("int").alias("page_number"), F.col("t").alias("page_text"))
    recs = page_records(pages)
    made = cleanings(recs)
    chunks = build_chunks(to_base_records(recs, "raw_text", "txt", source_file="source_file", page_number="page_number"), min_words=1, min_alpha=0.0)
    assert cleanings(chunks) == made + 1      # the record's own and the chunker's
    assert chunks.count() == 3
