"""All queries of the library by name, and the SQL that must give the same rows."""

from __future__ import annotations

from loomery.plans import annotation_queries, collocation_queries, dataflow_queries, element_queries, index_queries, knowledge_queries, parsing_queries, report_queries, state_queries, streaming_queries

_MODULES = (collocation_queries, dataflow_queries, element_queries, state_queries, knowledge_queries, parsing_queries, streaming_queries, annotation_queries, index_queries, report_queries)

QUERIES: dict = {name: f for module in _MODULES for name, f in module.QUERIES.items()}
SQL: dict[str, str] = {name: sql for module in _MODULES for name, sql in module.SQL.items()}
