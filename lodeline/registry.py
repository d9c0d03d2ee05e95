"""All queries of the core, by name, and their SQL."""

from __future__ import annotations

from lodeline.plans import facade_queries, partition_queries, row_queries, search_queries

MODULES = [search_queries, row_queries, partition_queries, facade_queries]


def queries() -> dict:
    return {k: f for m in MODULES for k, (f, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for m in MODULES for k, (_, sql) in m.QUERIES.items() if sql}
