"""All registered queries of the library and their SQL."""

from __future__ import annotations

from tessera.plans import catalogue_queries, coverage_queries, event_queries, graph_queries, report_queries, source_queries, text_queries

_ALL = {**event_queries.QUERIES, **text_queries.QUERIES, **graph_queries.QUERIES, **catalogue_queries.QUERIES, **source_queries.QUERIES, **coverage_queries.QUERIES, **report_queries.QUERIES}


def queries() -> dict:
    return {name: query for name, (query, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _ALL.items() if sql}
