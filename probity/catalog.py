"""Registry of the engine's own queries and their SQL."""
from __future__ import annotations

from probity.plans import activity_queries, family_queries, landed_queries, report_queries, store_queries, table_queries, text_queries

QUERIES = text_queries.QUERIES | activity_queries.QUERIES | table_queries.QUERIES | family_queries.QUERIES | landed_queries.QUERIES | report_queries.QUERIES | store_queries.QUERIES
ORACLE_SQL = text_queries.SQL | activity_queries.SQL | table_queries.SQL | family_queries.SQL | landed_queries.SQL | report_queries.SQL | store_queries.SQL
