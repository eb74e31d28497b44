"""The subpackage's registered queries and their SQL."""

from __future__ import annotations

from lexmill.llm import op1_embeddings, op2_lines, op3_mixing, op4_simhash, op5_substrings, op6_pii, op7_html, op8_language, op9_quality, op10_sentencepiece

MODULES = (op1_embeddings, op2_lines, op3_mixing, op4_simhash, op5_substrings, op6_pii, op7_html, op8_language, op9_quality, op10_sentencepiece)


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.SQL.items()}
