"""The operators' registered queries, over whole tables."""

from __future__ import annotations

from quire.llm import alignment
from quire.llm import decontaminate as dec
from quire.llm import jaccard, language_id, lexical_search, licenses, main_text, mixing, pii, quality, repeats, secret_scan
from quire.llm import sentencepiece_bpe as spb
from quire.llm.oracle import ORACLE
from quire.llm.tables import read


def tokenizer_path(name: str = "piece_bpe_32k.model") -> str:
    """Where the public tokenizer's vocabulary file lies on this machine."""
    import public_tokenizers
    return str(public_tokenizers.path(name))


def op1_host_quality(spark, sf_dir):
    return quality.quality(read(spark, sf_dir, "documents"))


def op2_ngram_jaccard(spark, sf_dir):
    return jaccard.ngram_jaccard(read(spark, sf_dir, "documents"))


def op3_main_text(spark, sf_dir):
    return main_text.extract_main_text(read(spark, sf_dir, "pages"))


def op4_secret_scan(spark, sf_dir):
    return secret_scan.secret_scan(read(spark, sf_dir, "documents"))


def op5_pii_scan(spark, sf_dir):
    return pii.pii_scan(read(spark, sf_dir, "documents"))


def op6_sentencepiece(spark, sf_dir, model: str | None = None):
    return spb.sentencepiece_tokens(read(spark, sf_dir, "documents"), model or tokenizer_path())


def op7_lm_score(spark, sf_dir):
    return mixing.lm_score(read(spark, sf_dir, "documents"))


def op8_decontaminate(spark, sf_dir):
    return dec.decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op9_license_scan(spark, sf_dir):
    return licenses.license_scan(read(spark, sf_dir, "documents"), licenses.known_licenses(spark))


def op10_remove_repeats(spark, sf_dir):
    return repeats.remove_repeats(read(spark, sf_dir, "documents"))


def op11_ranked_search(spark, sf_dir):
    return lexical_search.ranked_search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op12_language_id(spark, sf_dir):
    return language_id.identify_language(read(spark, sf_dir, "documents"))


def op13_align_tokens(spark, sf_dir, a_path: str | None = None, b_path: str | None = None):
    return alignment.align_tokens(read(spark, sf_dir, "documents"), a_path or tokenizer_path("byte_bpe_50k.json"),
                                  b_path or tokenizer_path())


QUERIES = {f.__name__: f for f in (
    op1_host_quality, op2_ngram_jaccard, op3_main_text, op4_secret_scan, op5_pii_scan, op6_sentencepiece, op7_lm_score,
    op8_decontaminate, op9_license_scan, op10_remove_repeats, op11_ranked_search, op12_language_id,
    op13_align_tokens)}
