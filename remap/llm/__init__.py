"""Operators for preparing training data, and their registered queries."""

from remap.llm.queries import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
