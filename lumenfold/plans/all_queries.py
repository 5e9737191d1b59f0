"""Imports every module of queries, so that the registry is full."""

from . import pixel_queries, stats_queries, table_queries  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
