"""Measures of regions and glyphs: geometry of candidate words, features of form, evidence of residuals, segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from platen.functions import geometry as g
from platen.functions.status import PRESERVED, UNKNOWN, VIOLATED

from .aggregate import guarded_median


def codepoints(glyphs: DataFrame, keys: list[str], glyph: str, text: str) -> DataFrame:
    """keys, glyph, place, code: a row for each code point of a glyph's text; a glyph without text has none."""
    return glyphs.select(*keys, glyph, F.posexplode(F.filter(F.split(text, ""), lambda c: c != "")).alias("place", "char")).select(*keys, glyph, "place", F.ascii("char").alias("code"))


def candidate_geometry(glyphs: DataFrame, unit: list[str], x: str, advance: str, y: str) -> DataFrame:
    """unit, x0, x1, baseline: from the smallest start to the largest end of glyphs, whichever way they run, and the median baseline; all
    null where a baseline isn't finite."""
    end = F.col(x) + F.col(advance)
    made = glyphs.groupBy(*unit).agg(F.min(F.least(F.col(x), end)).alias("x0"), F.max(F.greatest(F.col(x), end)).alias("x1"), guarded_median(F.col(y)).alias("baseline"))
    known = F.col("baseline").isNotNull()
    return made.select(*unit, *[F.when(known, F.col(c)).alias(c) for c in ("x0", "x1", "baseline")])


def horizontal_residual(status: Column, start: Column, end: Column, width: Column) -> Column:
    """The largest of three quantised deltas; null where the status is unknown. Evidence that contradicts its status is an error:
    deltas are all there or all absent, and a verdict needs them."""
    every = start.isNotNull() & end.isNotNull() & width.isNotNull()
    none = start.isNull() & end.isNull() & width.isNull()
    largest = F.greatest(g.quantise(start), g.quantise(end), g.quantise(width))
    # An unknown status may have deltas; these must be fit to be quantised all the same.
    checked = F.when(largest < 0, largest)
    fault = F.raise_error(F.lit("horizontal evidence contradicts its status")).cast("long")
    return F.when((status == UNKNOWN) & none, F.lit(None).cast("long")).when((status == UNKNOWN) & every, checked).when(status.isin(PRESERVED, VIOLATED) & every, largest).otherwise(fault)


def baseline_residual(status: Column, delta: Column) -> Column:
    """The quantised delta; null where the status is unknown. A status without its delta, or a delta without status, is an error."""
    fault = F.raise_error(F.lit("baseline evidence contradicts its status")).cast("long")
    return F.when((status == UNKNOWN) & delta.isNull(), F.lit(None).cast("long")).when(status.isin(PRESERVED, VIOLATED) & delta.isNotNull(), g.quantise(delta)).otherwise(fault)


def region_features(regions: DataFrame, lines: DataFrame, page: str, region: str, width: str, height: str) -> DataFrame:
    """page, region and features, as shares of the page's width or height to four places.

    regions: page, region, x0, y0, x1, y1, width, height; lines: page, region, x0, x1. Medians and the deviation are over a region's lines; space
    before and after is that to the neighbours from the top, at least 0, null at the ends.
    """
    share = lambda x, of: F.round(x / F.col(of), 4)
    made = lines.withColumn("w", F.col("x1") - F.col("x0")).groupBy(page, region).agg(
        F.count("*").alias("line_count"), F.median("w").alias("middle"), F.max("w").alias("widest"), F.stddev_pop("w").alias("spread"), F.median("x0").alias("left"), (F.max("x0") - F.min("x0")).alias("left_spread")
    )
    w = Window.partitionBy(page).orderBy("y0", region)
    rows = regions.withColumn("before", F.greatest(F.lit(0.0), F.col("y0") - F.lag("y1").over(w))).withColumn("after", F.greatest(F.lit(0.0), F.lead("y0").over(w) - F.col("y1")))
    rows = rows.withColumn("before", F.when(F.lag("y1").over(w).isNotNull(), F.col("before"))).withColumn("after", F.when(F.lead("y0").over(w).isNotNull(), F.col("after")))
    rows = rows.join(made, [page, region], "left")
    none = lambda x: F.coalesce(x, F.lit(0.0))
    return rows.select(
        page, region, F.coalesce("line_count", F.lit(0)).alias("line_count"), share(none(F.col("middle")), width).alias("median_line_width_ratio"), share(none(F.col("widest")), width).alias("maximum_line_width_ratio"),
        share(none(F.col("spread")), width).alias("line_width_variation_ratio"), share(F.col("left"), width).alias("left_margin_ratio"), share(F.col("left_spread"), width).alias("left_margin_spread_ratio"),
        share(F.col("y0"), height).alias("top_ratio"), share(F.col("y1"), height).alias("bottom_ratio"), share(F.col("before"), height).alias("space_before_ratio"), share(F.col("after"), height).alias("space_after_ratio"),
    )


def zipped_arrays(rows: DataFrame, key: str, arrays: list[str]) -> DataFrame:
    """key, id, and an element of each array: they have one length, else the job fails."""
    same = F.array_min(F.array(*[F.size(a) for a in arrays])) == F.array_max(F.array(*[F.size(a) for a in arrays]))
    zipped = F.when(same, F.arrays_zip(*arrays)).otherwise(F.raise_error(F.lit("arrays of different lengths")))
    return rows.select(key, F.posexplode(zipped).alias("id", "x")).select(key, "id", "x.*")


def ordered_regions(blocks: DataFrame, detections: DataFrame, page: str, order: str, index: str, score: str) -> DataFrame:
    """blocks with score of the detection of the same order (the last listed), and place: known orders first, then as they came."""
    known = detections.where(F.col(order).isNotNull()).groupBy(page, order).agg(F.max_by(score, index).alias(score))
    place = F.row_number().over(Window.partitionBy(page).orderBy(F.col(order).isNull(), order, index)) - 1
    return blocks.withColumn("place", place).join(known, [page, order], "left")


#: Fixed value: how a witness marks an image, with its box in thousandths of the page.
IMAGE_TAG = r"""<img\s+src=["']images/bbox_(\d+)_(\d+)_(\d+)_(\d+)\.[^"']+["']\s*/?>"""


def tagged_segments(texts: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, segment, kind (text or visual), part, box: a text cut at its image tags, in order; the parts put together are the text."""
    bare = IMAGE_TAG.replace("(\\d+)", "\\d+")
    parts = texts.select(*keys, F.posexplode(F.regexp_extract_all(text, F.lit(f"(?is){bare}|(?:(?!{bare}).)+"), 0)).alias("segment", "part"))
    tag = F.col("part").rlike(f"(?is)\\A{bare}\\z")
    box = F.transform(F.array(*[F.regexp_extract("part", f"(?is){IMAGE_TAG}", n) for n in range(1, 5)]), lambda x: x.cast("int"))
    return parts.select(*keys, "segment", F.when(tag, "visual").otherwise("text").alias("kind"), "part", F.when(tag, box).alias("box"))


def ink_bands(bands: DataFrame, texts: DataFrame, page: str) -> DataFrame:
    """bands with kind: text or visual. bands: page, x0, y0, x1; texts: page, lines, width, height. As many bands as lines are all text; else those
    that are wide, or stand at the foot, must be as many, and the others are visual; null where they are not."""
    wide = (F.col("x1") - F.col("x0") >= F.col("width") * 0.12) | (F.col("y0") >= F.col("height") * 0.85)
    rows = bands.join(texts, page).withColumn("__wide", wide)
    counts = rows.groupBy(page).agg(F.count("*").alias("__n"), F.count_if("__wide").alias("__w"))
    rows = rows.join(counts, page)
    kind = F.when(F.col("__n") == F.col("lines"), "text").when(F.col("__w") == F.col("lines"), F.when(F.col("__wide"), "text").otherwise("visual"))
    return rows.withColumn("kind", kind).drop("__wide", "__n", "__w")


def detection_rate(trials: DataFrame, group: list[str], detected: Column) -> DataFrame:
    """group, mutations, found, score: the share of mutations that a check detects."""
    return trials.groupBy(*group).agg(F.count("*").alias("mutations"), F.count_if(detected).alias("found"), F.avg(detected.cast("double")).alias("score"))


def missing_splits(rows: DataFrame, group: list[str], split: str, needed: tuple[str, ...] = ("train", "validation")) -> DataFrame:
    """group, missing: groups that lack a split, and which."""
    made = rows.groupBy(*group).agg(F.array_except(F.array(*map(F.lit, needed)), F.collect_set(split)).alias("missing"))
    return made.where(F.size("missing") > 0)


def logical_glyphs(glyphs: DataFrame, group: list[str], order: str, font: str, y: str, left: Column, right: Column) -> DataFrame:
    """glyphs with place: runs of one font and height whose letters all run from the right are turned round. left, right: whether a glyph's
    text has letters of either direction (see text.directions)."""
    w = Window.partitionBy(*group).orderBy(order)
    new = F.coalesce(~(F.col(font).eqNullSafe(F.lag(font).over(w)) & F.col(y).eqNullSafe(F.lag(y).over(w))), F.lit(True))
    rows = glyphs.withColumn("__at", F.row_number().over(w)).withColumn("__new", F.when(F.col("__at") == 1, 1).otherwise(new.cast("int")))
    rows = rows.withColumn("__run", F.sum("__new").over(w))
    run = Window.partitionBy(*group, "__run")
    turned = F.max(right.cast("int")).over(run) - F.max(left.cast("int")).over(run) == 1
    first, last = F.min("__at").over(run), F.max("__at").over(run)
    place = F.when(F.coalesce(turned, F.lit(False)), first + last - F.col("__at")).otherwise(F.col("__at")) - 1
    return rows.withColumn("place", place).drop("__at", "__new", "__run")


def repaired_lines(lines: DataFrame, region: list[str], gap: str, start: str) -> DataFrame:
    """lines with new_x0 and repaired: ink that lies alone to the left of a line goes, if its siblings' edge and a wide gap agree.

    lines: x0, y0, x1, y1, and of the line's crop the widest gap and where its text begins after it (see raster.after_widest_gap),
    null where there is no gap. Of regions with fewer than three lines none is repaired. A region's lines bound the median.
    """
    edges = lines.groupBy(*region).agg(F.bround(F.median("x0")).alias("__left"), F.count("x0").alias("__lines"))
    height = F.greatest(F.lit(1), F.bround("y1") - F.bround("y0"))
    least = F.bround(height * 1.25)
    at = F.bround("x0") + F.col(start)
    off = (F.col("__lines") >= 3) & (F.col("__left") - F.bround("x0") > F.greatest(F.lit(12), least))
    repaired = F.coalesce(off & (F.col(gap) >= F.greatest(F.lit(10), least)) & (F.abs(at - F.col("__left")) <= height), F.lit(False))
    found = lines.join(edges, region, "left")
    return found.withColumn("repaired", repaired).withColumn("new_x0", F.when(F.col("repaired"), F.greatest(F.bround("x0"), at - 2)).otherwise(F.col("x0"))).drop("__left", "__lines")


def recomputed_boxes(regions: DataFrame, lines: DataFrame, region: list[str]) -> DataFrame:
    """regions with their lines' envelope as box, and changed. A region without lines keeps its own."""
    names = ("x0", "y0", "x1", "y1")
    made = lines.groupBy(*region).agg(F.struct(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")).alias("__box"))
    found = regions.join(made, region, "left")
    differs = F.lit(False)
    for n in names:
        differs = differs | ~F.col(n).eqNullSafe(F.col("__box")[n])
    found = found.withColumn("changed", F.col("__box").isNotNull() & differs)
    return found.select(*[F.when(F.col("changed"), F.col("__box")[x]).otherwise(F.col(x)).alias(x) if x in names else F.col(x) for x in found.columns if x != "__box"])
