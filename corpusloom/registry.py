"""Name -> query (spark, sf_dir), and name -> the same in DuckDB SQL."""

from __future__ import annotations

from corpusloom.plans import analytics, degraded, more, pages, requests, retrieval, scope, search, store, text

QUERIES: dict = {}
ORACLE_SQL: dict = {}
for _module in (retrieval, analytics, search, text, more, requests, store, scope, degraded, pages):
    QUERIES |= _module.QUERIES
    ORACLE_SQL |= _module.ORACLE_SQL
