"""All queries of the library, and their SQL equivalents."""

from __future__ import annotations

from . import block_queries, geometry_queries, model_queries, table_queries

QUERIES = {**block_queries.QUERIES, **table_queries.QUERIES, **geometry_queries.QUERIES, **model_queries.QUERIES}
ORACLE_SQL = {**block_queries.SQL, **table_queries.SQL, **geometry_queries.SQL, **model_queries.SQL}
