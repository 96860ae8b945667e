"""All queries outside the training-data subpackage, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from policygrid.plans import problems, q_generation, q_panel, q_policies, q_retrieval

_PARTS = (q_retrieval, q_policies, q_panel, q_generation, problems)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: f for p in _PARTS for k, f in p.QUERIES.items()}
SQL: dict[str, str] = {k: s for p in _PARTS for k, s in getattr(p, "SQL", {}).items()}
