"""All queries of the engine over the driver's tables, by name, with their SQL."""

from __future__ import annotations

from gneiss.plans import function_queries, graph_queries, more_queries, source_queries, table_queries

_MODULES = [graph_queries, table_queries, more_queries, function_queries, source_queries]
QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLE_SQL = {k: v for m in _MODULES for k, v in m.ORACLE_SQL.items()}
