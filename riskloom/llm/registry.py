"""Registered queries of the training-data operators, and the SQL where SQL can say the same."""

from __future__ import annotations

from riskloom.llm import (
    chat_format,
    cross_tokens,
    decontamination,
    exact_dedup,
    fill_middle,
    language_id,
    license_scan,
    line_dedup,
    maxent,
    packing,
    simhash,
    token_counts,
    toxicity,
)

MODULES = (chat_format, language_id, packing, exact_dedup, simhash, decontamination, token_counts, line_dedup, toxicity, license_scan, cross_tokens, maxent, fill_middle)
LLM_QUERIES = {name: run for module in MODULES for name, run in module.QUERIES.items()}
LLM_SQL = {name: text for module in MODULES for name, text in module.SQL.items()}
