"""All queries of the document engine and their SQL counterparts."""

from __future__ import annotations

from . import block_queries, convert_queries, page_queries, run_queries, strip_queries, text_queries

PARTS = (text_queries, block_queries, page_queries, convert_queries, run_queries, strip_queries)


def queries() -> dict:
    return {k: f for part in PARTS for k, f in part.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: s for part in PARTS for k, s in part.SQL.items()}
