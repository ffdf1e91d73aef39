"""Every query of the library by name, and for each the SQL that must give the same rows."""

from __future__ import annotations

from .plans import answers, audit, entities, exhibits, explanation, finalization, inference, mart, modeling, release, reports, robustness, summary  # noqa: F401
from .plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
