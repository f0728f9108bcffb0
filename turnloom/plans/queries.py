"""The library's queries and their DuckDB twins: QUERIES and ORACLE_SQL, by name."""

from __future__ import annotations

from turnloom.plans import corpus_queries, generator_queries, lesson_queries, model_queries, quality_queries, source_queries

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
for _part in (corpus_queries, quality_queries, generator_queries, lesson_queries, model_queries, source_queries):
    QUERIES.update(_part.QUERIES)
    ORACLE_SQL.update(_part.ORACLE_SQL)
