"""Plans out of observed lines: what a page can be set from, its layout, and why not where it can't."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from platen.functions import geometry as g
from platen.functions import text as t

#: The codes of what stands against a plan.
NO_LINES, NO_MAPPING = "no-lines", "page-mapping-unknown"


def ambiguous_orders(lines: DataFrame, group: list[str], key: str, line: str) -> DataFrame:
    """group, units: the lines, sorted, of each reading key that several share. An unknown key is shared by none."""
    rows = lines.where(F.col(key).isNotNull()).groupBy(*group, key).agg(F.sort_array(F.collect_list(line)).alias("units"))
    return rows.where(F.size("units") > 1).select(*group, "units")


def line_plans(pages: DataFrame, lines: DataFrame, page: str) -> DataFrame:
    """page, status, planned, total, lines, diagnostics: a row per page.

    pages: page, matrix (a homography, null where unknown). lines: page, unit, text, box (x0, y0, x1, y1), key (reading orders from the
    root down), baseline (points): null where a claim is unknown. Lacking text, box or key, a line separator in the text, a
    projection that fails and a reading key of several lines are diagnostics (code, unit, detail; a shared key has its units
    joined); with any of them, without a mapping or without lines the status is unknown and lines are null, else it is
    materializable. A page's lines lie in one row.
    """
    rows = lines.join(pages.select(page, "matrix"), page)
    box = g.project_box_plan(F.col("matrix"), F.col("box"))
    # A point's denominator is its side of the horizon, null where the point has no projection.
    side = lambda p: F.when(g.project(F.col("matrix"), p["x"], p["y"]).isNotNull(), F.signum(g.denominator(F.col("matrix"), p["x"], p["y"])))
    apart = lambda signs: F.exists(signs, lambda x: x.isNull()) | (F.array_min(signs) != F.array_max(signs))
    lost = F.col("baseline").isNotNull() & F.get(F.transform(F.array(F.transform("baseline", side)), apart), F.lit(0))
    diagnosis = lambda condition, code, detail: F.when(condition, F.struct(F.lit(code).alias("code"), F.col("unit").cast("string").alias("unit"), F.lit(detail).alias("detail")))
    whole = F.col("text").isNotNull() & F.col("box").isNotNull() & F.col("key").isNotNull()
    rows = rows.withColumn("target", box).withColumn("lost", F.coalesce(lost, F.lit(False))).withColumn("broken", t.line_end(F.col("text")).isNotNull())
    broken, mapped = F.col("broken"), F.col("matrix").isNotNull()
    sound = whole & ~broken & F.col("target").isNotNull() & ~F.col("lost")
    faults = F.filter(
        F.array(
            *[diagnosis(F.col(c).isNull(), "required-claim-unknown", n) for c, n in (("text", "text"), ("box", "bbox"), ("key", "reading-order"))],
            diagnosis(whole & broken, "explicit-line-separator", "text"),
            diagnosis(whole & ~broken & F.col("target").isNull(), "projection-failed", "bbox"),
            diagnosis(whole & ~broken & F.col("target").isNotNull() & F.col("lost"), "projection-failed", "baseline"),
        ),
        lambda x: x.isNotNull(),
    )
    good = mapped & sound
    rows = rows.withColumn("faults", F.when(mapped & ~sound, faults))
    made = rows.groupBy(page).agg(
        F.count("*").alias("total"), F.count_if(good).alias("planned"), F.flatten(F.collect_list("faults")).alias("faults"),
        F.array_sort(F.collect_list(F.when(good, F.struct("key", "unit", "text", "target")))).alias("found"),
    )
    out = pages.select(page, "matrix").join(made, page, "left")
    # Lines lie by key, so those that share one lie together.
    again = F.filter("found", lambda x, i: (i > 0) & (x["key"] == F.get(F.col("found"), i - 1)["key"]))
    joined = lambda k: F.array_join(F.transform(F.filter("found", lambda x: x["key"] == k), lambda x: x["unit"].cast("string")), ",")
    shared = F.transform(F.array_distinct(F.transform(again, lambda x: x["key"])), lambda k: F.struct(F.lit("ambiguous-reading-order").alias("code"), joined(k).alias("unit"), F.lit("reading-order").alias("detail")))
    one = lambda code: F.array(F.struct(F.lit(code).alias("code"), F.lit(None).cast("string").alias("unit"), F.lit(None).cast("string").alias("detail")))
    total = F.coalesce("total", F.lit(0))
    diagnostics = F.when(total == 0, one(NO_LINES)).when(F.col("matrix").isNull(), one(NO_MAPPING)).otherwise(F.array_sort(F.concat("faults", shared)))
    out = out.withColumn("diagnostics", diagnostics)
    clean = F.size("diagnostics") == 0
    return out.select(page, F.when(clean, "materializable").otherwise("unknown").alias("status"), F.coalesce("planned", F.lit(0)).alias("planned"), total.alias("total"), F.when(clean, F.col("found")).alias("lines"), "diagnostics")


def _projected(lines: DataFrame, pages: DataFrame, page: str) -> DataFrame:
    rows = lines.join(pages.select(page, "matrix", "width", "height"), page)
    return rows.withColumn("target", g.project_box_layout(F.col("matrix"), F.col("box")))


def _finite(*values: Column) -> Column:
    out = F.lit(True)
    for x in values:
        out &= x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return out


def page_layout(pages: DataFrame, lines: DataFrame, page: str) -> DataFrame:
    """page, lines, reason, x0, y0, x1, y1, inset_top, inset_left, inset_right, inset_bottom: a row per page.

    pages: page, matrix, width, height; lines: page, box. Measures are null with a reason: page-mapping-unknown, no-lines,
    incomplete-line-bbox or projection-failed, in this order.
    """
    made = _projected(lines, pages, page).groupBy(page).agg(
        F.count("*").alias("lines"), F.count_if(F.col("box").isNull()).alias("without"), F.count_if(F.col("box").isNotNull() & F.col("target").isNull()).alias("lost"),
        *[f(F.col("target")[n]).alias(n) for f, n in ((F.min, "x0"), (F.min, "y0"), (F.max, "x1"), (F.max, "y1"))],
    )
    out = pages.join(made, page, "left").withColumn("lines", F.coalesce("lines", F.lit(0)))
    insets = {"inset_top": F.col("y0"), "inset_left": F.col("x0"), "inset_right": F.col("width") - F.col("x1"), "inset_bottom": F.col("height") - F.col("y1")}
    reason = F.when(F.col("matrix").isNull(), NO_MAPPING).when(F.col("lines") == 0, NO_LINES).when(F.col("without") > 0, "incomplete-line-bbox").when((F.col("lost") > 0) | ~_finite(*insets.values()), "projection-failed")
    known = F.col("reason").isNull()
    return out.withColumn("reason", reason).select(page, "lines", "reason", *[F.when(known, F.col(c)).alias(c) for c in ("x0", "y0", "x1", "y1")], *[F.when(known, x).alias(n) for n, x in insets.items()])


def region_layout(pages: DataFrame, regions: DataFrame, lines: DataFrame, page: str) -> DataFrame:
    """page, region, place, lines, reason, x0, y0, x1, y1, support, starts, gaps: a row per region.

    regions: page, region, ord; lines: page, region, line, ord, box. place numbers a page's regions, known orders first, then by name.
    support: the lines by order, or by name where an order is unknown; starts: their left edges; gaps: from a line's bottom to the
    next one's top. Measures are null with a reason: page-mapping-unknown, no-lines, incomplete-line-reading-order,
    incomplete-line-bbox or projection-failed, in this order. A region's lines lie in one row.
    """
    rows = _projected(lines, pages, page)
    made = rows.groupBy(page, "region").agg(
        F.count("*").alias("lines"), F.count_if(F.col("ord").isNull()).alias("unordered"), F.count_if(F.col("box").isNull()).alias("without"), F.count_if(F.col("box").isNotNull() & F.col("target").isNull()).alias("lost"),
        F.array_sort(F.collect_list(F.struct("ord", "line", "target"))).alias("by_order"), F.array_sort(F.collect_list(F.struct("line", "ord", "target"))).alias("by_name"),
    )
    place = F.row_number().over(Window.partitionBy(page).orderBy(F.col("ord").isNull(), "ord", "region")) - 1
    out = regions.select(page, "region", place.alias("place")).join(made, [page, "region"], "left").join(pages.select(page, "matrix"), page, "left")
    out = out.withColumn("lines", F.coalesce("lines", F.lit(0)))
    reason = (
        F.when(F.col("matrix").isNull(), NO_MAPPING).when(F.col("lines") == 0, NO_LINES).when(F.col("unordered") > 0, "incomplete-line-reading-order")
        .when(F.col("without") > 0, "incomplete-line-bbox").when(F.col("lost") > 0, "projection-failed")
    )
    out = out.withColumn("reason", reason)
    boxes = F.transform("by_order", lambda x: x["target"])
    each = lambda n: F.transform(boxes, lambda b: b[n])
    known = F.col("reason").isNull()
    gaps = F.zip_with(F.slice(boxes, 2, F.greatest(F.col("lines").cast("int") - 1, F.lit(0))), F.slice(boxes, 1, F.greatest(F.col("lines").cast("int") - 1, F.lit(0))), lambda below, above: below["y0"] - above["y1"])
    support = F.when(F.col("unordered") > 0, F.transform("by_name", lambda x: x["line"])).otherwise(F.transform("by_order", lambda x: x["line"]))
    measures = {"x0": F.array_min(each("x0")), "y0": F.array_min(each("y0")), "x1": F.array_max(each("x1")), "y1": F.array_max(each("y1"))}
    return out.select(page, "region", "place", "lines", "reason", *[F.when(known, x).alias(n) for n, x in measures.items()], support.alias("support"), F.when(known, each("x0")).alias("starts"), F.when(known, gaps).alias("gaps"))


def unit_order(units: DataFrame, group: list[str], parent_order: str, order: str, unit: str) -> DataFrame:
    """units with place: by the parent's order (none counts as 0), own order with unknown ones last, then name."""
    w = Window.partitionBy(*group).orderBy(F.coalesce(parent_order, F.lit(0)), F.col(order).isNull(), order, unit)
    return units.withColumn("place", F.row_number().over(w) - 1)


#: Diagnostics that contradict what was asked for; others only leave it open.
VIOLATIONS = ("text_sequence_mismatch", "face_mismatch", "family_mismatch")


def attested(subjects: DataFrame, diagnostics: DataFrame, key: str, code: str) -> DataFrame:
    """key, status, codes: violated by any violation, preserved without diagnostics, else unknown; codes once each, sorted."""
    made = diagnostics.groupBy(key).agg(F.bool_or(F.col(code).isin(*VIOLATIONS)).alias("violated"), F.array_sort(F.collect_set(code)).alias("codes"))
    out = subjects.select(key).join(made, key, "left")
    return out.select(key, F.when(F.col("codes").isNull(), "preserved").when(F.col("violated"), "violated").otherwise("unknown").alias("status"), F.coalesce("codes", F.array().cast("array<string>")).alias("codes"))


def opaque(font_model: DataFrame, interpreter: DataFrame, code: str) -> DataFrame:
    """Diagnostics that leave a font's use open: those of fonts but for missing widths, and all of the text's interpretation."""
    return font_model.where(F.col(code) != "NoWidths").unionByName(interpreter)
