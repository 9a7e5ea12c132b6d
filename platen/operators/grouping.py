"""Dealing out rows to grouped Python functions."""

from __future__ import annotations

from pyspark.sql import DataFrame


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """rows by keys over as many partitions as the session shuffles to. A grouped Python function costs time that doesn't show in
    bytes, so partitions must not be merged by size, as they are where Spark adds the shuffle itself."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
