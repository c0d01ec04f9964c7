"""Imports every query module so that the registry is filled."""

from boxtally.plans import audit_queries, geometry_queries, matching_queries, metric_queries, sampling_queries, source_queries, suppression_queries, voxel_queries  # noqa: F401
from boxtally.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
