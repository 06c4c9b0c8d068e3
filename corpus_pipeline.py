"""Corpus pipeline: STAGES over ``documents``; each stage works on all rows its
predecessor kept, its result written as Parquet and read again.

Every stage but the last returns the columns of ``documents``.
"""

from __future__ import annotations

from quire.llm import decontaminate, jaccard, quality, secret_scan
from quire.llm import sentencepiece_bpe as spb
from quire.llm.queries import tokenizer_path
from quire.llm.tables import read, write_once


def good_documents(spark, docs, sf_dir):
    """Operator 1: documents that the host-level quality rules reject go."""
    return quality.keep_good(docs)


def distinct_documents(spark, docs, sf_dir):
    """Operator 2: of each group of near copies (five-word shingles, similarity 0.8
    or more) the document of the smallest id stays."""
    return jaccard.keep_one(docs)


def clean_documents(spark, docs, sf_dir):
    """Operator 8: documents that hold a window of a benchmark item go."""
    return decontaminate.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def masked_documents(spark, docs, sf_dir):
    """Operator 4: secrets are masked in the texts; ``n_chars`` is the new length."""
    return secret_scan.redact_secrets(docs)


def token_digests(spark, docs, sf_dir):
    """Operator 6: number and digest of the ids of each text, digest of the decoded text."""
    return spb.sentencepiece_tokens(docs, tokenizer_path())


STAGES = [
    ("quality rules", good_documents),
    ("n-gram Jaccard join", distinct_documents),
    ("benchmark decontamination", clean_documents),
    ("secret scans", masked_documents),
    ("SentencePiece encoding and decoding", token_digests),
]
# The encoder and the trained network are beyond SQL; tests hold run() against a
# brute-force version of all five stages.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The result of all stages over the whole ``documents``."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = write_once(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return docs
