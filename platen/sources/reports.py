"""Reports as JSON: keys in a fixed order, numbers in their shortest decimals, absent measurements left out or null as the format says.

Each report's name is a parameter, for it belongs to whoever reads it. Keys and status words are the format's fixed values.
A list holds the rows of one page, which bounds it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def quoted(x: Column) -> Column:
    """JSON text of a string or whole number; null is null."""
    made = F.to_json(F.array(x), {"ignoreNullFields": "false"})
    return F.substring(made, F.lit(2), F.length(made) - 2)


def number(x: Column, name: str = "a field") -> Column:
    """Shortest decimals without an exponent; null is null; an error where it isn't finite."""
    x = x.cast("double")
    said = F.abs(x).cast("string")
    digits = F.regexp_replace(F.substring_index(said, "E", 1), r"\.0$", "")
    power = F.when(F.contains(said, F.lit("E")), F.substring_index(said, "E", -1).cast("int")).otherwise(0)
    whole, part = F.substring_index(digits, ".", 1), F.when(F.contains(digits, F.lit(".")), F.substring_index(digits, ".", -1)).otherwise("")
    every = F.concat(whole, part)
    up = F.when(power >= F.length(part), F.concat(every, F.repeat(F.lit("0"), power - F.length(part)))).otherwise(
        F.concat(F.substring(every, F.lit(1), power + 1), F.lit("."), F.substring(every, power + 2, F.length(every)))
    )
    down = F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), every)
    made = F.concat(F.when((x < 0) | ((x == 0) & said.isNotNull() & x.cast("string").startswith("-")), "-").otherwise(""), F.when(power > 0, up).when(power < 0, down).otherwise(digits))
    finite = ~F.isnan(x) & (F.abs(x) != float("inf"))
    return F.when(x.isNull(), "null").when(finite, made).otherwise(F.raise_error(F.lit(f"{name} is not finite")))


def made(**fields: Column) -> Column:
    """An object of JSON texts, in this order."""
    parts: list[Column] = []
    for k, (name, x) in enumerate(fields.items()):
        parts += [F.lit(f'{"," if k else "{"}"{name}":'), x]
    return F.concat(*parts, F.lit("}"))


def optional(name: str, x: Column) -> Column:
    """A further field, or nothing where x is null."""
    return F.when(x.isNull(), "").otherwise(F.concat(F.lit(f',"{name}":'), number(x, name)))


def listed(texts: Column) -> Column:
    """An array of JSON texts as a list; null is an empty one."""
    return F.concat(F.lit("["), F.coalesce(F.array_join(texts, ","), F.lit("")), F.lit("]"))


def gathered(rows: DataFrame, key: str, order: list[str], text: Column, name: str) -> DataFrame:
    """key, name: the rows' JSON texts as a list, in order."""
    item = F.struct(F.struct(*order).alias("o"), text.alias("t"))
    return rows.groupBy(key).agg(listed(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["t"])).alias(name))


def _head(schema: str) -> dict[str, Column]:
    return {"schema": quoted(F.lit(schema)), "schema_version": F.lit("1")}


def _source() -> Column:
    return made(page_index=quoted(F.col("page_index")), raster_sha256=quoted(F.col("raster_sha256")))


def _hypothesis() -> Column:
    """Columns font_family, font_size_pt, font_weight, font_style, tracking_pt."""
    return made(font_family=quoted(F.col("font_family")), font_size_pt=number(F.col("font_size_pt"), "font_size_pt"), font_weight=quoted(F.col("font_weight")), font_style=quoted(F.col("font_style")), tracking_pt=number(F.col("tracking_pt"), "tracking_pt"))


def _coverage() -> Column:
    return made(**{n: quoted(F.col(n)) for n in ("matched_scan", "total_scan", "matched_candidate", "total_candidate")})


def _artifacts() -> dict[str, Column]:
    return {n: quoted(F.col(n)) for n in ("source_sha256", "source_size_bytes", "pdf_sha256", "pdf_size_bytes")}


def requirement(least: float | None) -> Column:
    return F.lit('{"status":"not-required"}') if least is None else made(status=F.lit('"known"'), value=number(F.lit(float(least))))


def comparison(heads: DataFrame, matches: DataFrame, lost_scans: DataFrame, lost_candidates: DataFrame, reflows: DataFrame, diagnostics: DataFrame, key: str, schema: str, policy: dict[str, object]) -> DataFrame:
    """key, json.

    heads: key, page_index, raster_sha256, the three statuses, the four counts of coverage. All others: key, ord; matches: scan_unit_id,
    line, start, stop, four deltas (left out where null), two statuses; lost_scans: scan_unit_id; lost_candidates: line, start, stop; reflows:
    scan_line_id, lines, scan_word_ids; diagnostics: list (observation, pdf or comparison), json. policy: granularity, horizontal, baseline, text, geometry.
    """
    span = lambda: listed(F.array(quoted(F.col("start")), quoted(F.col("stop"))))
    match = made(scan_unit_id=quoted(F.col("scan_unit_id")), candidate_line_index=quoted(F.col("line")), candidate_scalar_range=span())
    deltas = [optional(n, F.col(n)) for n in ("dx_start", "dx_end", "width_delta", "baseline_delta")]
    states = F.concat(*[F.concat(F.lit(f',"{n}":'), quoted(F.col(n))) for n in ("horizontal_status", "baseline_status")])
    match = F.concat(F.substring(match, F.lit(1), F.length(match) - 1), *deltas, states, F.lit("}"))
    flow = made(scan_line_id=quoted(F.col("scan_line_id")), candidate_line_indices=listed(F.transform("lines", lambda x: quoted(x))), scan_word_ids=listed(F.transform("scan_word_ids", lambda x: quoted(x))))
    lists = {
        "matches": gathered(matches, key, ["ord"], match, "matches"),
        "unmatched_scan": gathered(lost_scans, key, ["ord"], quoted(F.col("scan_unit_id")), "unmatched_scan"),
        "unmatched_candidate": gathered(lost_candidates, key, ["ord"], made(candidate_line_index=quoted(F.col("line")), candidate_scalar_range=span()), "unmatched_candidate"),
        "reflow": gathered(reflows, key, ["ord"], flow, "reflow"),
    }
    for name in ("observation", "pdf", "comparison"):
        lists[f"{name}_diagnostics"] = gathered(diagnostics.where(F.col("list") == name), key, ["ord"], F.col("json"), f"{name}_diagnostics")
    rows = heads
    for part in lists.values():
        rows = rows.join(part, key, "left")
    rule = made(
        granularity=quoted(F.lit(policy["granularity"])),
        text_normalization=F.lit('"exact"'),
        horizontal_tolerance_pt=number(F.lit(policy["horizontal"])),
        baseline_tolerance_pt=number(F.lit(policy["baseline"])),
        min_text_confidence=requirement(policy["text"]),
        min_geometry_confidence=requirement(policy["geometry"]),
    )
    states = {f"{n}_status": quoted(F.col(f"{n}_status")) for n in ("content", "geometry", "overall")}
    return rows.select(key, made(**_head(schema), source=_source(), policy=rule, **states, coverage=_coverage(), **{n: F.coalesce(n, F.lit("[]")) for n in lists}).alias("json"))


def validation(schema: str) -> Column:
    """Columns page_index, raster_sha256, media_type, width_px, height_px, units, provenance_records, diagnostics (counts)."""
    fields = lambda *names: made(**{n: quoted(F.col(n)) for n in names})
    return made(
        **_head(schema),
        status=F.lit('"valid"'),
        scope=F.lit('"contract-and-raster-identity"'),
        source=fields("page_index", "raster_sha256", "media_type", "width_px", "height_px"),
        counts=fields("units", "provenance_records", "diagnostics"),
    )


def evaluation(schema: str) -> Column:
    """Columns of the source, the hypothesis, the artifacts, compiler_version, and comparison: that report's JSON."""
    return made(**_head(schema), source=_source(), hypothesis=_hypothesis(), compiler_version=quoted(F.col("compiler_version")), **_artifacts(), comparison=F.col("comparison"))


def attestation(subjects: DataFrame, diagnostics: DataFrame, resources: DataFrame, key: str, schema: str) -> DataFrame:
    """key, json. subjects: as for evaluation, with status, expected_scalar_count, candidate_scalar_count, published; an error where something was
    published without a preserved status. diagnostics: key, code, resource_name, scalar_index; resources: key, resource_name, base_font, normalized_stem, glyph_count."""
    codes, fonts = ("code", "resource_name", "scalar_index"), ("resource_name", "base_font", "normalized_stem", "glyph_count")
    said = gathered(diagnostics, key, list(codes), made(**{n: quoted(F.col(n)) for n in codes}), "__said")
    used = gathered(resources, key, ["resource_name"], made(**{n: quoted(F.col(n)) for n in fonts}), "__used")
    rows = subjects.join(said, key, "left").join(used, key, "left")
    found = made(**{n: quoted(F.col(n)) for n in ("status", "expected_scalar_count", "candidate_scalar_count")}, diagnostics=F.coalesce("__said", F.lit("[]")), used_resources=F.coalesce("__used", F.lit("[]")))
    report = made(
        **_head(schema), source=_source(), hypothesis=_hypothesis(), fallback_policy=F.lit('"forbidden"'), compiler_version=quoted(F.col("compiler_version")), **_artifacts(),
        attestation=found, comparison=F.col("comparison"), artifact_published=F.col("published").cast("string"),
    )
    fault = F.col("published") & (F.col("status") != "preserved")
    return rows.select(key, F.when(fault, F.raise_error(F.lit("published without a preserved attestation"))).otherwise(report).alias("json"))


def trial() -> Column:
    """One trial's JSON. Columns: index, the hypothesis, artifacts, three statuses, coverage, reason (null: eligible), horizontal_ids, baseline_ids,
    horizontal_violations, horizontal_residuals, baseline_violations, baseline_residuals."""
    words = lambda n: listed(F.transform(n, lambda x: quoted(x)))
    states = {f"{n}_status": quoted(F.col(f"{n}_status")) for n in ("content", "geometry", "overall")}
    support = made(horizontal_scan_unit_ids=words("horizontal_ids"), known_baseline_scan_unit_ids=words("baseline_ids"))
    score = made(horizontal_violations=quoted(F.col("horizontal_violations")), horizontal_residuals_desc=words("horizontal_residuals"), baseline_violations=quoted(F.col("baseline_violations")), baseline_residuals_desc=words("baseline_residuals"))
    fits = F.col("reason").isNull()
    eligible = F.when(fits, made(status=F.lit('"eligible"'))).otherwise(made(status=F.lit('"ineligible"'), reason=quoted(F.col("reason"))))
    return made(index=quoted(F.col("index")), hypothesis=_hypothesis(), **_artifacts(), **states, coverage=_coverage(), eligibility=eligible, support=F.when(fits, support).otherwise("null"), score=F.when(fits, score).otherwise("null"))


def selection(selected: Column, tied: Column, reason: Column, scope: Column) -> Column:
    """JSON of the one trial that was chosen, of several that are equal (an array), or of why there is none; the first that isn't null counts."""
    one = made(status=F.lit('"selected"'), selected_index=quoted(selected), evidence_scope=quoted(scope), artifact_published=F.lit("true"))
    many = made(status=F.lit('"tied"'), indices=listed(F.transform(tied, lambda x: quoted(x))), evidence_scope=quoted(scope), artifact_published=F.lit("false"))
    none = made(status=F.lit('"inconclusive"'), reason=quoted(reason), evidence_scope=F.lit("null"), artifact_published=F.lit("false"))
    return F.when(selected.isNotNull(), one).when(tied.isNotNull(), many).otherwise(none)


def search(heads: DataFrame, trials: DataFrame, key: str, schema: str) -> DataFrame:
    """key, json. heads: key, the source, font_family, font_weight, font_style, sizes, trackings, compiler_version, selection and winner (JSON; null
    without one); trials: key and what trial() reads. hypothesis_count is the size of the grid."""
    texts = lambda n: listed(F.transform(n, lambda x: number(x + 0.0, n)))
    space = made(font_family=quoted(F.col("font_family")), font_weight=quoted(F.col("font_weight")), font_style=quoted(F.col("font_style")), font_sizes_pt=texts("sizes"), trackings_pt=texts("trackings"), hypothesis_count=quoted(F.size("sizes") * F.size("trackings")))
    rows = heads.join(gathered(trials, key, ["index"], trial(), "__trials"), key, "left")
    report = made(**_head(schema), source=_source(), search_space=space, compiler_version=quoted(F.col("compiler_version")), trials=F.coalesce("__trials", F.lit("[]")), selection=F.col("selection"), winner=F.coalesce("winner", F.lit("null")))
    return rows.select(key, report.alias("json"))
