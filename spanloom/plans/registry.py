"""Every query of the engine, with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from spanloom.plans import format_queries, interval_queries, score_queries, sink_queries, text_queries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
for _module in (interval_queries, score_queries, text_queries, sink_queries, format_queries):
    QUERIES |= _module.QUERIES
    ORACLE_SQL |= _module.ORACLE_SQL


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments to candidate spans, merge, cap, gate, statistics: one row an episode."""
    return QUERIES["episode_pipeline"](spark, sf_dir)
