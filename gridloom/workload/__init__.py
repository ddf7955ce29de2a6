"""Registered queries over the given tables, with their checking SQL."""

from gridloom.workload import export_queries, raster_queries, source_queries, task_queries  # noqa: F401
from gridloom.workload.registered import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
