"""Queries by topic; importing a module registers its queries."""

from turnwise.plans import interval_queries, metric_queries, qc_queries, score_queries, stream_queries, text_queries  # noqa: F401
from turnwise.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
