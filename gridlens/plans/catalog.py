"""All queries over meter tables, with their SQL."""

from __future__ import annotations

from gridlens.plans import cleaning, electrical, events, features, models, scores, sources  # noqa: F401  registers them
from gridlens.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
