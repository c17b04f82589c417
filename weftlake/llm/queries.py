"""Registry of the subpackage's queries and of their DuckDB SQL."""

from __future__ import annotations

from weftlake.llm import edit_embedding, filter_audit, lang_id, license_scan, line_dedup, main_text, merkle, mixing, ngram_join, ogg, pieces, url_filter, vector_dedup

QUERIES = {
    "op1_url_filters": url_filter.op1_url_filters,
    "op2_line_dedup": line_dedup.op2_line_dedup,
    "op3_ngram_jaccard_join": ngram_join.op3_ngram_jaccard_join,
    "op5_source_mixing": mixing.op5_source_mixing,
    "op4_document_fingerprints": edit_embedding.op4_document_fingerprints,
    "op6_embedding_dedup": vector_dedup.op6_embedding_dedup,
    "op7_license_scans": license_scan.op7_license_scans,
    "op8_language_id": lang_id.op8_language_id,
    "op9_html_extraction": main_text.op9_html_extraction,
    "op10_sentencepiece": pieces.op10_sentencepiece,
    "op11_filter_interactions": filter_audit.op11_filter_interactions,
    "op12_media_columns": ogg.op12_media_columns,
    "op13_merkle_manifest": merkle.op13_merkle_manifest,
}
SQL = {
    "op1_url_filters": url_filter.SQL,
    "op3_ngram_jaccard_join": ngram_join.SQL,
    "op6_embedding_dedup": vector_dedup.SQL,
    "op7_license_scans": license_scan.SQL,
    "op11_filter_interactions": filter_audit.SQL,
    "op13_merkle_manifest": merkle.SQL,
}
