"""Name -> query callable, and name -> DuckDB SQL for the same result."""

from __future__ import annotations

from quire.plans import catalog as c
from quire.plans.oracle import ORACLE

QUERIES = {
    "clean_text": c.q_clean_text,
    "clean_document_text": c.q_clean_document_text,
    "chunk_words": c.q_chunk_words,
    "chunk_sentences": c.q_chunk_sentences,
    "build_chunks": c.q_build_chunks,
    "quality_gates": c.q_quality_gates,
    "chunk_stats": c.q_chunk_stats,
    "row_to_text": c.q_row_to_text,
    "staging_chunks": c.q_staging_chunks,
    "detect_language": c.q_detect_language,
    "red_flags": c.q_red_flags,
    "match_rules": c.q_match_rules,
    "validate_questions": c.q_validate_questions,
    "snippets": c.q_snippets,
    "embed_hashing": c.q_embed_hashing,
    "knn_centroids": c.q_knn_centroids,
    "knn_self": c.q_knn_self,
    "bm25": c.q_bm25,
    "hybrid": c.q_hybrid,
    "retrieve": c.q_retrieve,
    "page_documents": c.q_page_documents,
    "page_records": c.q_page_records,
    "page_structured": c.q_page_structured,
    "index_sync": c.q_index_sync,
    "index_status": c.q_index_status,
    "prompts": c.q_prompts,
    "ask_batch": c.q_ask_batch,
    "stream_sync": c.q_stream_sync,
    "knn_lsh": c.q_knn_lsh,
    "lsh_recall": c.q_lsh_recall,
    "labelled_records": c.q_labelled_records,
    "source_counts_sql": c.q_source_counts_sql,
    "embedding_check": c.q_embedding_check,
    "staging_to_processed": c.q_staging_to_processed,
    "preview": c.q_preview,
    "extract_pages": c.q_extract_pages,
    "translation_messages": c.q_translation_messages,
    "language_lookup": c.q_language_lookup,
    "citations": c.q_citations,
    "score_names": c.q_score_names,
    "site_documents": c.q_site_documents,
    "file_build": c.q_file_build,
    "knn_cells": c.q_knn_cells,
    "bm25_postings": c.q_bm25_postings,
    "bm25_filtered": c.q_bm25_filtered,
    "index_refresh": c.q_index_refresh,
    "index_change_log": c.q_index_change_log,
    "stream_late": c.q_stream_late,
    "length_report": c.q_length_report,
    "length_report_sql": c.q_length_report_sql,
    "ask_plugins": c.q_ask_plugins,
    "hit_passages": c.q_hit_passages,
    "text_pages": c.q_text_pages,
    "stored_tables": c.q_stored_tables,
}


def _shipped(fn):
    def run(spark, sf_dir):
        from quire.session import ship_package
        ship_package(spark)
        return fn(spark, sf_dir)

    run.__name__ = fn.__name__
    run.__doc__ = fn.__doc__
    return run


def queries():
    return {name: _shipped(fn) for name, fn in QUERIES.items()}


def oracle_sql():
    return {k: v for k, v in ORACLE.items() if k in QUERIES}
