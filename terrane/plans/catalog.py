"""All core queries by name, with their SQL."""

from __future__ import annotations

from terrane.plans import estate_queries, problems, source_queries, text_queries, view_queries

QUERIES = {**estate_queries.QUERIES, **text_queries.QUERIES, **view_queries.QUERIES, **source_queries.QUERIES, **problems.QUERIES}
ORACLE: dict[str, str] = {**estate_queries.ORACLE, **text_queries.ORACLE, **view_queries.ORACLE, **source_queries.ORACLE, **problems.ORACLE}
