"""Queries of the library's operators and their DuckDB forms."""

from . import flow_queries, price_queries, profile_queries, stored_queries, work_queries

_PARTS = (price_queries, work_queries, flow_queries, stored_queries, profile_queries)
QUERIES = {k: v for p in _PARTS for k, v in p.QUERIES.items()}
ORACLE = {k: v for p in _PARTS for k, v in p.ORACLE.items()}
