"""Registered queries: one Spark job and, where possible, its SQL twin."""

from fieldloom.catalog.registry import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
