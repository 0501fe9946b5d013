"""All registered queries."""

from workload import insight_queries, metric_queries, quality_queries  # noqa: F401
from workload.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
