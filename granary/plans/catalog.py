"""All queries of the grounding engine by name, with the SQL that gives the same rows."""

from __future__ import annotations

from granary.plans import batch, corpus, evidence, ledger, records, release, reports, search, storage  # noqa: F401
from granary.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
