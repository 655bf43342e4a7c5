"""All registered queries of the library and their SQL."""

from __future__ import annotations

from .plans import field_queries, run_queries  # noqa: F401  (register their queries)
from .plans.queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
