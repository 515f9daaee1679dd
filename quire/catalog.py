"""The registered queries of the document operators and their SQL counterparts."""

from __future__ import annotations

from quire.plans import lint_queries, run_queries, text_queries  # noqa: F401 - they register their queries
from quire.plans.queries import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
