"""The registered queries: each applies an operator to whole tables, most with the same question in SQL beside it."""

from graphloom.plans import advising, building, catalogue, evaluation, payloads, resolution, sessions, statistics, storing  # noqa: F401
from graphloom.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
