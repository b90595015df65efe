"""Every registered query of the engine and its SQL twin."""

from oreline.plans import codecs, dedup, evidence, governance, leaves, numeric, shapes, text  # noqa: F401
from oreline.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
