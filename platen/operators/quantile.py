"""Exact quantiles of a few large groups, in bounded memory.

An aggregate that holds a group's values doesn't fit two groups of everything. Here values are counted in BINS equal
ranges between a group's ends, the ranges that hold the wanted ranks are cut again, and what is left is counted
value by value. Each step is a count with partial sums; no task holds a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BINS, CUTS = 4096, 2


def _bin(value: Column) -> Column:
    """0 to BINS - 1 over lo..hi; it never falls as the value rises."""
    share = F.try_divide(value - F.col("lo"), F.col("hi") - F.col("lo"))
    return F.least(F.floor(F.coalesce(share, F.lit(0.0)) * BINS), F.lit(BINS - 1)).cast("int")


def quantiles(rows: DataFrame, group: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """group and a column for each share: the value at that share of the way through the group's sorted values, between
    neighbours in proportion. Nulls don't count; a group without values isn't there. Values are finite doubles."""
    own = rows.select(*[F.col(g).alias(f"g{n}") for n, g in enumerate(group)], F.col(value).cast("double").alias("v")).where("v IS NOT NULL")
    keys = [f"g{n}" for n in range(len(group))]
    ends = own.groupBy(*keys).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    place = lambda s: F.lit(s) * (F.col("n") - 1)
    wanted = F.array(*[F.struct(F.lit(name).alias("name"), r.cast("long").alias("rank")) for name, s in shares.items() for r in (F.floor(place(s)), F.ceil(place(s)))])
    targets = ends.select(*keys, "lo", "hi", F.lit(0).cast("long").alias("below"), F.explode(F.array_distinct(F.transform(wanted, lambda x: x["rank"]))).alias("rank"))
    for _ in range(CUTS):
        spans = targets.select(*keys, "lo", "hi").distinct()
        inside = own.join(spans, keys).where(F.col("v").between(F.col("lo"), F.col("hi")))
        counts = inside.groupBy(*keys, "lo", "hi", _bin(F.col("v")).alias("bin")).agg(F.count("*").alias("c"), F.min("v").alias("bin_lo"), F.max("v").alias("bin_hi"))
        upto = F.sum("c").over(Window.partitionBy(*keys, "lo", "hi").orderBy("bin"))  # at most BINS rows
        counts = counts.withColumn("upto", upto)
        hit = targets.join(counts, [*keys, "lo", "hi"]).where((F.col("rank") - F.col("below") < F.col("upto")) & (F.col("rank") - F.col("below") >= F.col("upto") - F.col("c")))
        targets = hit.select(*keys, F.col("bin_lo").alias("lo"), F.col("bin_hi").alias("hi"), (F.col("below") + F.col("upto") - F.col("c")).alias("below"), "rank")
    spans = targets.select(*keys, "lo", "hi", "below").distinct()
    counts = own.join(spans, keys).where(F.col("v").between(F.col("lo"), F.col("hi"))).groupBy(*keys, "lo", "hi", "below", "v").agg(F.count("*").alias("c"))
    counts = counts.withColumn("upto", F.col("below") + F.sum("c").over(Window.partitionBy(*keys, "lo", "hi").orderBy("v")))
    found = targets.join(counts, [*keys, "lo", "hi", "below"]).where((F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("c")))
    found = found.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("at"))  # two ranks for each share
    out = ends.join(found, keys)

    def between(s: float) -> Column:
        p = place(s)
        low, high = (F.element_at("at", f(p).cast("long")) for f in (F.floor, F.ceil))
        return F.when(F.floor(p) == F.ceil(p), low).otherwise((F.ceil(p) - p) * low + (p - F.floor(p)) * high)

    return out.select(*[F.col(f"g{n}").alias(g) for n, g in enumerate(group)], *[between(s).alias(name) for name, s in shares.items()])
