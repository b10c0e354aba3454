"""All registered queries."""

from workload import job_queries, operator_queries  # noqa: F401
from workload.registry import CHECKS, QUERIES

__all__ = ["CHECKS", "QUERIES"]
