"""Registry: the name of each query, its Spark form and its SQL."""

from __future__ import annotations

from locusframe.plans.queries import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
