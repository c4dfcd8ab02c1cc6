"""All queries of the reference catalogue, by name, with their oracle SQL."""

from __future__ import annotations

from . import queries  # noqa: F401  registers
from .queries.base import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
