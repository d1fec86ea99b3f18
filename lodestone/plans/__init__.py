"""Registered queries over the test tables."""

from . import storage  # noqa: F401  registers its queries
from .queries import flagship, oracle_sql, queries

__all__ = ["flagship", "oracle_sql", "queries"]
