"""Registered queries by family."""

from . import analytics, coverage, evidence, texts
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "analytics", "coverage", "evidence", "texts"]
