"""The subpackage's queries and, where SQL can say them, their SQL."""

from __future__ import annotations

from weirflow.llm import bpe, language_id, line_dedup, nearest, ngram_join, quality_rules, source_mixing, token_counts, toxicity, url_filters

QUERIES = {
    "op1_bpe": bpe.query,
    "op2_source_mixing": source_mixing.query,
    "op3_token_counts": token_counts.query,
    "op4_url_filters": url_filters.query,
    "op5_line_dedup": line_dedup.query,
    "op6_toxicity": toxicity.query,
    "op7_quality_rules": quality_rules.query,
    "op8_language_id": language_id.query,
    "op9_ngram_join": ngram_join.query,
    "op10_nearest": nearest.query,
}

SQL = {
    "op2_source_mixing": source_mixing.SQL,
    "op4_url_filters": url_filters.SQL,
    "op7_quality_rules": quality_rules.SQL,
}
