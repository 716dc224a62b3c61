"""Registered queries of the retention operators and their DuckDB equivalents."""

from tidemark.plans.queries import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
