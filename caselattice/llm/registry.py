"""Queries of the llm operators, and their SQL where SQL can express them."""

from __future__ import annotations

from . import chat_format, html_text, line_dedup, merkle, mixing, ngram_join, packing, pii, quality_rules, sharding, spelling, tiff, url_filters

MODULES = [pii, sharding, quality_rules, mixing, line_dedup, packing, tiff, ngram_join, url_filters, chat_format, merkle, spelling, html_text]


def queries() -> dict:
    return {name: q for m in MODULES for name, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLE.items()}
