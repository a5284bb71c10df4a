"""Name -> DataFrame function, and the SQL that gives the same rows."""

from __future__ import annotations

from fundloom.plans import flow_queries, graph_queries, more_queries, risk_queries, source_queries

MODULES = [risk_queries, graph_queries, more_queries, flow_queries, source_queries]
QUERIES: dict = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLE_SQL: dict = {name: text for m in MODULES for name, text in m.ORACLE_SQL.items()}
