"""All core queries and their SQL."""

from __future__ import annotations

from quarrymill.plans import alignment, corpus, evaluation, relational, statements, streams, topics  # noqa: F401
from quarrymill.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
