"""Words, segments, zones, templates and families held against candidates: one partner or none, with the reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from platen.functions import status as s
from platen.functions.text import folded

from .aggregate import weighted_score


def only(rows: DataFrame, key: list[str], fields: list[str], name: str) -> DataFrame:
    """key, <name>_n, name: a struct of fields where a key has one row, null where it has several. A row per key, so a join with it
    adds none."""
    made = rows.groupBy(*key).agg(F.count("*").alias(f"{name}_n"), F.min(F.struct(*fields)).alias(name))
    return made.withColumn(name, F.when(F.col(f"{name}_n") == 1, F.col(name)))


def words_by_key(scans: DataFrame, candidates: DataFrame, key: str, absolute: float = 1.5, em: float = 0.1, confidence: float = 0.5) -> DataFrame:
    """scans with candidate_line, tolerance, deltas and statuses, by the only candidate word of the same key; several scans may take one.

    scans: key, x0, x1, baseline, confidence; candidates: key, line, x0, x1, baseline, size. Without an only candidate or a box all is
    unknown; without a baseline of that confidence the vertical status is.
    """
    found = scans.join(only(candidates, [key], ["line", "x0", "x1", "baseline", "size"], "c"), key, "left")
    c, boxed = F.col("c"), F.col("c").isNotNull() & F.col("x0").isNotNull() & F.col("x1").isNotNull()
    trusted = boxed & F.coalesce(F.col("confidence") >= confidence, F.lit(False)) & ~F.coalesce(F.isnan("confidence") | F.isnan("baseline"), F.lit(False))
    found = found.select(
        *[x for x in scans.columns],
        F.when(boxed, c["line"]).alias("candidate_line"),
        F.when(boxed, F.greatest(F.lit(absolute), em * c["size"])).alias("tolerance"),
        F.when(boxed, F.col("x0") - c["x0"]).alias("d_start"),
        F.when(boxed, F.col("x1") - c["x1"]).alias("d_end"),
        F.when(boxed, (F.col("x1") - F.col("x0")) - (c["x1"] - c["x0"])).alias("d_width"),
        F.when(trusted, F.col("baseline") - c["baseline"]).alias("d_baseline"),
    )
    found = found.withColumn("horizontal", s.horizontal(F.col("d_start"), F.col("d_end"), F.col("d_width"), F.col("tolerance")))
    found = found.withColumn("vertical", s.from_delta(F.col("d_baseline"), F.col("tolerance")))
    return found.withColumn("status", s.combine(F.col("horizontal"), F.col("vertical")))


def segments_of_tokens(tokens: DataFrame, segments: DataFrame, line: list[str], text: str, fields: list[str]) -> DataFrame:
    """tokens with segment: the fields of the only segment on their line whose text is the same but for case; null for white space,
    without such a segment and with several."""
    rows = tokens.withColumn("__key", F.when(F.col("kind") != "whitespace", folded(F.col(text))))
    keyed = segments.withColumn("__key", folded(F.coalesce(F.col(text), F.lit(""))))
    return rows.join(only(keyed, [*line, "__key"], fields, "segment"), [*line, "__key"], "left").drop("__key", "segment_n")


def candidate_profile(segments: DataFrame, profiles: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """segments with profile, and why there is none: candidate-word-ambiguous for no profile of the key or several."""
    found = segments.join(only(profiles, [key], fields, "profile"), key, "left").drop("profile_n")
    return found.withColumn("reason", F.when(F.col("profile").isNull(), "candidate-word-ambiguous"))


def zones(left: DataFrame, right: DataFrame, page: str) -> DataFrame:
    """page, zone, delta_x, delta_y, height_ratio, width_ratio, gap_delta, status, by the place of zones on a page.

    left, right: page, zone (from 0), center_x, center_y, height, left, right, top, bottom. A page with other numbers of zones has one row,
    unknown, without a zone; gap_delta is null after the last zone. Ratios to nothing are null.
    """
    ahead = Window.partitionBy(page).orderBy("zone")
    side = lambda df, name: df.select(page, "zone", F.struct("center_x", "center_y", "height", (F.col("right") - F.col("left")).alias("width"), (F.lead("top").over(ahead) - F.col("bottom")).alias("gap")).alias(name))
    both = side(left, "l").join(side(right, "r"), [page, "zone"], "full")
    uneven = both.groupBy(page).agg(F.bool_or(F.col("l").isNull() | F.col("r").isNull()).alias("uneven")).where("uneven").select(page)
    a, b = F.col("l"), F.col("r")
    pairs = both.join(uneven, page, "left_anti").select(
        page,
        "zone",
        F.bround(a["center_x"] - b["center_x"], 3).alias("delta_x"),
        F.bround(a["center_y"] - b["center_y"], 3).alias("delta_y"),
        F.bround(F.try_divide(a["height"], b["height"]), 4).alias("height_ratio"),
        F.bround(F.try_divide(a["width"], b["width"]), 4).alias("width_ratio"),
        (a["gap"] - b["gap"]).alias("gap_delta"),
        F.lit("comparable").alias("status"),
    )
    return pairs.unionByName(uneven.withColumn("status", F.lit("unknown")), allowMissingColumns=True)


def best_template(found: DataFrame, page: str, order: str, score: str, width: Column, height: Column, least: float) -> DataFrame:
    """page, order, score, box, crop: the detection of a page that is most like a template, from least on; the first of equal ones.

    found: x0, y0, x1, y1 in pixels of pages of that size. Boxes under 20 by 10, over a third of the width or a fifth of the height don't
    count. crop has a margin of 12 % of the longer side, 4 at least, within the page.
    """
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    fits = (w >= 20) & (h >= 10) & (w <= F.floor(width / 3)) & (h <= F.floor(height / 5)) & (F.col(score) >= least)
    margin = F.greatest(F.lit(4), F.bround(F.greatest(w, h) * 0.12).cast("int"))
    crop = F.struct(F.greatest(F.lit(0), F.col("x0") - margin).alias("x0"), F.greatest(F.lit(0), F.col("y0") - margin).alias("y0"), F.least(width, F.col("x1") + margin).alias("x1"), F.least(height, F.col("y1") + margin).alias("y1"))
    rows = found.where(fits).select(page, F.struct((-F.col(score)).alias("s"), F.col(order).alias("o")).alias("k"), F.struct(F.col(order), F.col(score), F.struct("x0", "y0", "x1", "y1").alias("box"), crop.alias("crop")).alias("v"))
    return rows.groupBy(page).agg(F.min_by("v", "k").alias("v")).select(page, "v.*")


def first_best(trials: DataFrame, group: list[str], key: list[str], index: str) -> DataFrame:
    """Per group the trial of the smallest key; the first of equal ones; trials that lack part of the key don't count."""
    known = F.lit(True)
    for k in key:
        known = known & F.col(k).isNotNull()
    rest = [x for x in trials.columns if x not in group]
    made = trials.where(known).groupBy(*group).agg(F.min_by(F.struct(*rest), F.struct(*key, index)).alias("v"))
    return made.select(*group, "v.*")


def canonical(diagnostics: DataFrame, group: list[str], code: str, resource: str, position: str, detail: str) -> DataFrame:
    """group, rank and the four, each once: by code, resource, position (absent ones first) and detail."""
    once = diagnostics.select(*group, code, resource, position, detail).distinct()
    by = [F.col(code), F.coalesce(F.col(resource), F.lit("")), F.col(position).asc_nulls_first(), F.col(detail).asc_nulls_first()]
    return once.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*by, F.col(resource).asc_nulls_first())))


def ranked_families(alternatives: DataFrame, samples: DataFrame, threshold: float, limit: int) -> tuple[DataFrame, DataFrame]:
    """(ranked, rejected). alternatives: family, sample, score, style, path; samples: sample, weight, required.

    Each family takes for each sample its best face (score, then style, then path). One without any for a required sample is rejected: family,
    reason, missing. The others are ranked by their weighted score, then family, style and path of the face that counts most; the first
    limit come back, with the status of the whole: matched if the first reaches threshold, else fallback_required.
    """
    if not 0 <= threshold <= 1 or limit < 1:
        raise ValueError("a threshold lies between 0 and 1, and a limit is positive")
    best = alternatives.groupBy("family", "sample").agg(F.max(F.struct("score", "style", "path")).alias("b"))
    needed = samples.where("required").select("sample")
    total = needed.agg(F.count("*").alias("__needed"))
    have = best.join(needed, "sample", "left_semi").groupBy("family").agg(F.count("*").alias("have"))
    families = alternatives.select("family").distinct().join(have, "family", "left").crossJoin(F.broadcast(total))
    missing = (F.col("__needed") - F.coalesce("have", F.lit(0))).alias("missing")
    checked = families.select("family", missing)
    rejected = checked.where("missing > 0").select("family", F.lit("required_evidence_missing").alias("reason"), "missing")
    rows = best.join(samples, "sample").join(checked.where("missing = 0").select("family"), "family", "left_semi")
    value = F.round(F.col("b.score"), 6)
    made = rows.groupBy("family").agg(weighted_score(value, F.col("weight")).alias("overall"), F.max(F.struct((value * F.col("weight")).alias("v"), F.col("b.style").alias("style"), F.col("b.path").alias("path"))).alias("r"))
    made = made.select("family", "r.style", "r.path", "overall").orderBy(F.desc("overall"), "family", "style", "path").limit(limit)
    rank = Window.orderBy(F.desc("overall"), "family", "style", "path")
    made = made.withColumn("rank", F.row_number().over(rank))
    top = F.max("overall").over(Window.partitionBy())
    return made.withColumn("status", F.when(top >= threshold, "matched").otherwise("fallback_required")), rejected


def stage_totals(reports: DataFrame, group: list[str], stage: str, seconds: str) -> DataFrame:
    """Seconds of each stage, to six decimals, summed as decimals so that their order is nothing."""
    return reports.groupBy(*group, stage).agg(F.sum(F.col(seconds).cast("decimal(28,9)")).alias("t")).select(*group, stage, F.round("t", 6).cast("double").alias("seconds"))


def page_lists(reports: DataFrame, group: list[str], page: str, status: str) -> DataFrame:
    """group, outcome, page: processed for success and partial, partial as well for these, failed for any other status."""
    ok = F.col(status).isin("success", "partial")
    outcomes = F.when(F.col(status) == "partial", F.array(F.lit("processed"), F.lit("partial"))).when(ok, F.array(F.lit("processed"))).otherwise(F.array(F.lit("failed")))
    return reports.select(*group, F.explode(outcomes).alias("outcome"), page)
