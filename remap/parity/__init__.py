"""Registered queries and their SQL twins.

Each query runs a library operator over whole tables and has an independently
written SQL text that any SQL engine can run on the same tables.
"""

from remap.parity import (  # noqa: F401  (importing registers the queries)
    catalog,
    changes,
    filters,
    joins,
    lists,
    loads,
    lookups,
    owners,
    plans,
    reports,
    scalars,
)
from remap.parity.registry import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
