"""Registered queries of the recommendation-evaluation operators, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import catalogs, context, registry, reports  # noqa: F401  (they register their queries)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = registry.QUERIES
ORACLE_SQL: dict[str, str] = registry.ORACLE_SQL
FLAGSHIP = "ranker_metrics"
