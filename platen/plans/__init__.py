"""Registered queries over the driver's tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import catalogue, check_queries, compare_queries, line_queries, measure_queries, page_queries, raster_queries, region_queries  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q.spark for name, q in catalogue.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: q.sql for name, q in catalogue.QUERIES.items() if q.sql}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue.QUERIES["tri_state_rollup"].spark(spark, sf_dir)
