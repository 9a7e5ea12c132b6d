"""Exact aggregates of measurements, and selection that keeps ties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _odd(x: Column) -> Column:
    return F.isnan(x) | (F.abs(x) == float("inf"))


def guarded_median(x: Column) -> Column:
    """Exact; null if a value isn't finite."""
    return F.when(~F.coalesce(F.bool_or(_odd(x)), F.lit(False)), F.median(x))


def largest(x: Column) -> Column:
    return F.max(F.abs(x))


def cluster_shift(pairs: DataFrame, group: list[str], dx: str, dy: str) -> DataFrame:
    return pairs.groupBy(*group).agg(F.median(dx).alias("median_dx"), F.median(dy).alias("median_dy"), F.count("*").alias("pairs"))


def relative_to_cluster(pairs: DataFrame, group: list[str], delta: str) -> DataFrame:
    """pairs with relative: what is left of delta beyond its cluster's median."""
    medians = pairs.groupBy(*group).agg(F.median(delta).alias("__m"))
    return pairs.join(medians, group).withColumn("relative", F.col(delta) - F.col("__m")).drop("__m")


def fit_key(residuals: DataFrame, trial: list[str], steps: str, limit: int) -> DataFrame:
    """trial, support, violations, vector, total: the steps beyond limit, then all of them from the largest down."""
    return residuals.groupBy(*trial).agg(
        F.count("*").alias("support"), F.count_if(F.col(steps) > limit).alias("violations"), F.sort_array(F.collect_list(steps), asc=False).alias("vector"), F.sum(steps).alias("total")
    )


def argmin_with_ties(trials: DataFrame, key: list[str], name: str, support: str | None = None) -> DataFrame:
    """name, verdict of the trials with the smallest key: selected if it is one alone, tied if several.

    With support, trials that rest on other numbers of measurements cannot be compared: verdict inconclusive, for all.
    """
    keyed = F.struct(*[F.col(k) for k in key])
    best = trials.agg(F.min(keyed).alias("__best"), *([F.count_distinct(support).alias("__supports")] if support else [F.lit(1).alias("__supports")]))
    rows = trials.withColumn("__key", keyed).join(F.broadcast(best), F.lit(True))  # one row
    rows = rows.where((F.col("__key") == F.col("__best")) | (F.col("__supports") > 1))
    many = rows.agg(F.count("*").alias("__n"))
    rows = rows.join(F.broadcast(many), F.lit(True))
    verdict = F.when(F.col("__supports") > 1, "inconclusive").when(F.col("__n") == 1, "selected").otherwise("tied")
    return rows.select(name, verdict.alias("verdict"))


def supported_mode(rows: DataFrame, group: list[str], value: str) -> DataFrame:
    """The whole number with most values at it or one beside it; of equal ones the smallest."""
    counts = rows.groupBy(*group, value).agg(F.count("*").alias("n"))
    near = counts.select(*group, F.explode(F.array(F.col(value) - 1, F.col(value), F.col(value) + 1)).alias(value), "n")
    support = near.groupBy(*group, value).agg(F.sum("n").alias("support")).join(counts.select(*group, value), [*group, value], "left_semi")
    return support.groupBy(*group).agg(F.min_by(value, F.struct(-F.col("support"), F.col(value))).alias("mode"), F.max("support").alias("support"))


def deviation_threshold(rows: DataFrame, group: list[str], value: str, floor: float, factor: float = 1.5) -> DataFrame:
    """group, middle, mad, threshold: the median and factor times the median absolute deviation beyond it, floor at least."""
    medians = rows.groupBy(*group).agg(F.median(value).alias("middle"))
    apart = rows.join(medians, group).groupBy(*group).agg(F.first("middle").alias("middle"), F.median(F.abs(F.col(value) - F.col("middle"))).alias("mad"))
    return apart.withColumn("threshold", F.greatest(F.lit(floor), F.col("middle") + factor * F.col("mad")))


def first_mode(rows: DataFrame, group: list[str], value: str, order: str) -> DataFrame:
    """The most frequent value; of equal ones that which comes first by order."""
    counts = rows.groupBy(*group, value).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    return counts.groupBy(*group).agg(F.min_by(value, F.struct(-F.col("n"), F.col("first"))).alias("mode"), F.max("n").alias("n"))


def otsu(histogram: DataFrame, group: list[str], bin: str, n: str) -> DataFrame:
    """group, threshold: the bin up to which values form one class, by the largest variance between two; the first of equal ones."""
    w = Window.partitionBy(*group).orderBy(bin)
    every = Window.partitionBy(*group)
    rows = histogram.withColumn("w0", F.sum(n).over(w)).withColumn("s0", F.sum(F.col(bin) * F.col(n)).over(w))
    rows = rows.withColumn("w1", F.sum(n).over(every) - F.col("w0")).withColumn("s1", F.sum(F.col(bin) * F.col(n)).over(every) - F.col("s0"))
    between = F.when((F.col("w0") > 0) & (F.col("w1") > 0), F.col("w0") * F.col("w1") * F.pow(F.try_divide("s0", "w0") - F.try_divide("s1", "w1"), 2)).otherwise(0.0)
    return rows.withColumn("between", between).groupBy(*group).agg(F.min_by(bin, F.struct(-F.col("between"), F.col(bin))).alias("threshold"))


def weighted_score(value: Column, weight: Column) -> Column:
    """Null without weight."""
    return F.try_divide(F.sum(value * weight), F.sum(weight))


def ordered_vote(rows: DataFrame, group: list[str], vote: str, confidence: str, least: float = 0.5) -> DataFrame:
    """group, winner, share: the value with most votes if it has that share; the higher mean confidence breaks ties, then the value."""
    counts = rows.groupBy(*group, vote).agg(F.count("*").alias("n"), F.avg(confidence).alias("mean"))
    best = counts.groupBy(*group).agg(F.min_by(vote, F.struct(-F.col("n"), -F.col("mean"), F.col(vote))).alias("winner"), F.max("n").alias("top"), F.sum("n").alias("all"))
    share = F.col("top") / F.col("all")
    return best.select(*group, F.when(share >= least, F.col("winner")).alias("winner"), share.alias("share"))
