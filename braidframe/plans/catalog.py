"""Query registry: name to function, name to the SQL it is compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import queries_core, queries_extra, queries_graph, queries_lift, queries_more
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "queries_core", "queries_extra", "queries_graph", "queries_lift", "queries_more"]
Query = Callable[[SparkSession, str], DataFrame]
