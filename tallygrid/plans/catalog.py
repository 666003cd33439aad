"""Registered queries over the given tables and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallygrid.plans import grid_queries, io_queries, plugin_queries, record_queries, registry, text_queries  # noqa: F401  importing registers


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.QUERIES["a2_grouped_summary"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.ORACLES)
