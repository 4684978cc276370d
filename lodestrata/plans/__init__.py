"""Registered queries."""

from lodestrata.plans import formats
from lodestrata.plans.base import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES", "formats"]
