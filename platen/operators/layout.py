"""Page layout from line boxes: insets, gaps, indents, master pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .quantile import quantiles


def insets(lines: DataFrame, page: list[str], width: str, height: str) -> DataFrame:
    """page with envelope and what the page leaves around it; unknown (null, reason) if a line has no box."""
    made = lines.groupBy(*page).agg(
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.first(width).alias("w"), F.first(height).alias("h"), F.count_if(F.col("x0").isNull() | F.col("y0").isNull() | F.col("x1").isNull() | F.col("y1").isNull()).alias("without")
    )
    known = F.col("without") == 0
    return made.select(
        *page, F.when(known, F.col("x0")).alias("inset_left"), F.when(known, F.col("y0")).alias("inset_top"), F.when(known, F.col("w") - F.col("x1")).alias("inset_right"), F.when(known, F.col("h") - F.col("y1")).alias("inset_bottom"), F.when(~known, "line-without-box").alias("reason")
    )


def signed_gaps(lines: DataFrame, group: list[str], order: str) -> DataFrame:
    """lines with gap: from a line's bottom to the next one's top, negative where they overlap; null for the last."""
    return lines.withColumn("gap", F.lead("y0").over(Window.partitionBy(*group).orderBy(order)) - F.col("y1"))


def first_indent(lines: DataFrame, group: list[str], order: str) -> DataFrame:
    """group, indent: the first line's start against the smallest of the others; null for a single line."""
    first = lines.groupBy(*group).agg(F.min(order).alias("__first"))
    rows = lines.join(first, group)
    return rows.groupBy(*group).agg((F.min_by("x0", order) - F.min(F.when(F.col(order) > F.col("__first"), F.col("x0")))).alias("indent"))


def masters(pages: DataFrame, side: str, measures: list[str]) -> DataFrame:
    """Median of each measure per side, and the number of pages. Sides are few and large, so no task holds one."""
    out = pages.groupBy(side).agg(F.count("*").alias("pages"))
    for m in measures:
        out = out.join(quantiles(pages, [side], m, {f"median_{m}": 0.5}), side, "left")
    return out


def frozen_audit(pages: DataFrame, side: str, measure: str, most: float = 0.15) -> DataFrame:
    """pages with deviation from their side's median and mark: whether it exceeds that share of it; null where the median is 0."""
    rows = pages.join(quantiles(pages, [side], measure, {"frozen": 0.5}), side)
    deviation = F.try_divide(F.abs(F.col(measure) - F.col("frozen")), F.abs("frozen"))
    return rows.withColumn("deviation", deviation).withColumn("mark", F.col("deviation") > most)


def leading(lines: DataFrame, group: list[str], order: str, baseline: str) -> DataFrame:
    """group, steps, leading: how many baselines lie below the one before, and the median of those distances."""
    step = F.lead(baseline).over(Window.partitionBy(*group).orderBy(order)) - F.col(baseline)
    return lines.withColumn("__step", step).where("__step > 0").groupBy(*group).agg(F.count("*").alias("steps"), F.median("__step").alias("leading"))
