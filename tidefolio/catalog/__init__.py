"""Registered queries, each beside the SQL it is checked against."""

from tidefolio.catalog.registry import oracle_sql, queries  # noqa: F401
