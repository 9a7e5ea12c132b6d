"""Words, segments, zones, templates, families, scopes and reports over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from platen.functions import claims, geometry, rules, status
from platen.operators import compare, regions, scope
from platen.sources import content, reports, sinks

from .catalogue import query, table

WORDS = """s AS (SELECT l_orderkey, l_linenumber, l_partkey AS k, l_quantity AS x0, l_quantity + l_linenumber AS x1, CASE WHEN l_suppkey % 3 > 0 THEN l_quantity + l_suppkey % 4 END AS baseline, l_tax * 10 AS confidence FROM lineitem),
c AS (SELECT p_partkey - p_partkey % 3 * CAST(p_size > 25 AS INTEGER) AS k, p_partkey AS line, CAST(p_size AS DOUBLE) AS x0, p_size + 3.0::DOUBLE AS x1, CAST(p_size AS DOUBLE) AS baseline, CAST(10 + p_partkey % 90 AS DOUBLE) AS size FROM part),
o AS (SELECT k, min(line) AS line, min(x0) AS x0, min(x1) AS x1, min(baseline) AS baseline, min(size) AS size FROM c GROUP BY k HAVING count(*) = 1)"""


def _words(spark, sf_dir):
    quantity = F.col("l_quantity")
    scans = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("k"), quantity.alias("x0"), (quantity + F.col("l_linenumber")).alias("x1"), F.when(F.col("l_suppkey") % 3 > 0, quantity + F.col("l_suppkey") % 4).alias("baseline"), (F.col("l_tax") * 10).alias("confidence"))
    size = F.col("p_size").cast("double")
    parts = table(spark, sf_dir, "part").select((F.col("p_partkey") - F.when(F.col("p_size") > 25, F.col("p_partkey") % 3).otherwise(0)).alias("k"), F.col("p_partkey").alias("line"), size.alias("x0"), (size + 3).alias("x1"), size.alias("baseline"), (10 + F.col("p_partkey") % 90).cast("double").alias("size"))
    return scans, parts


@query(
    f"""WITH {WORDS}, j AS (SELECT l_orderkey, l_linenumber, o.line AS candidate_line, greatest(1.5::DOUBLE, 0.1::DOUBLE * size) AS tolerance, s.x0 - o.x0 AS a, s.x1 - o.x1 AS b, (s.x1 - s.x0) - (o.x1 - o.x0) AS w,
  CASE WHEN o.line IS NOT NULL AND confidence >= 0.5 THEN s.baseline - o.baseline END AS v FROM s LEFT JOIN o USING (k)),
t AS (SELECT *, CASE WHEN candidate_line IS NULL THEN 'unknown' WHEN abs(a) <= tolerance AND abs(b) <= tolerance AND abs(w) <= tolerance THEN 'preserved' ELSE 'violated' END AS horizontal,
  CASE WHEN v IS NULL THEN 'unknown' WHEN abs(v) <= tolerance THEN 'preserved' ELSE 'violated' END AS vertical FROM j)
SELECT l_orderkey, l_linenumber, candidate_line, horizontal, vertical, CASE WHEN 'violated' IN (horizontal, vertical) THEN 'violated' WHEN 'unknown' IN (horizontal, vertical) THEN 'unknown' ELSE 'preserved' END AS status FROM t"""
)
def words_by_key(spark, sf_dir):
    made = compare.words_by_key(*_words(spark, sf_dir), "k")
    return made.select("l_orderkey", "l_linenumber", "candidate_line", "horizontal", "vertical", "status")


@query(
    """WITH t AS (SELECT l_orderkey AS region, l_linenumber % 2 AS line, l_linenumber AS token, lower(l_returnflag) AS text, l_partkey, l_linestatus FROM lineitem),
g AS (SELECT l_orderkey AS region, l_linenumber % 2 AS line, lower(l_returnflag) AS text, count(*) AS n, min(l_suppkey) AS segment FROM lineitem WHERE l_tax > 0.03 GROUP BY ALL)
SELECT region, line, token, l_partkey, CASE WHEN n = 1 AND l_linestatus <> 'F' THEN segment END AS segment FROM t LEFT JOIN g USING (region, line, text)"""
)
def segments_of_tokens(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("region"), (F.col("l_linenumber") % 2).alias("line"), F.col("l_linenumber").alias("token"), F.col("l_returnflag").alias("text"), "l_partkey", "l_suppkey", "l_tax", F.when(F.col("l_linestatus") == "F", "whitespace").otherwise("word").alias("kind"))
    segments = rows.where("l_tax > 0.03").withColumn("text", F.lower("text"))
    made = compare.segments_of_tokens(rows, segments, ["region", "line"], "text", ["l_suppkey"])
    return made.select("region", "line", "token", "l_partkey", F.col("segment.l_suppkey").alias("segment"))


@query(
    """WITH p AS (SELECT p_brand, count(*) AS n, min(p_size) AS size FROM part WHERE p_size > 48 AND p_partkey % 7 = 0 GROUP BY ALL)
SELECT p_partkey, CASE WHEN n = 1 THEN size END AS size, CASE WHEN coalesce(n, 0) <> 1 THEN 'candidate-word-ambiguous' END AS reason FROM part LEFT JOIN p USING (p_brand)"""
)
def candidate_profile(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    made = compare.candidate_profile(part.select("p_partkey", "p_brand"), part.where("p_size > 48 AND p_partkey % 7 = 0"), "p_brand", ["p_size"])
    return made.select("p_partkey", F.col("profile.p_size").alias("size"), "reason")


@query(
    """WITH z AS (SELECT l_orderkey AS page, l_returnflag AS side, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS zone, l_quantity AS cx, l_partkey AS cy, l_linenumber AS h, l_suppkey + 7 AS w, l_partkey AS top, l_partkey + l_linenumber AS bottom FROM lineitem WHERE l_returnflag <> 'N'),
a AS (SELECT *, lead(top) OVER (PARTITION BY page ORDER BY zone) - bottom AS gap FROM z WHERE side = 'A'), r AS (SELECT *, lead(top) OVER (PARTITION BY page ORDER BY zone) - bottom AS gap FROM z WHERE side = 'R'),
n AS (SELECT page FROM z GROUP BY page HAVING count(*) FILTER (WHERE side = 'A') = count(*) FILTER (WHERE side = 'R'))
SELECT page, CAST(zone AS INTEGER) AS zone, a.cx - r.cx AS delta_x, CAST(a.cy - r.cy AS DOUBLE) AS delta_y, round_even(a.h / r.h, 4) AS height_ratio, round_even(a.w / r.w, 4) AS width_ratio, a.gap - r.gap AS gap_delta, 'comparable' AS status
FROM a JOIN r USING (page, zone) JOIN n USING (page) UNION ALL SELECT DISTINCT page, NULL, NULL, NULL, NULL, NULL, NULL, 'unknown' FROM z WHERE page NOT IN (SELECT page FROM n)"""
)
def zone_pairs(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").where("l_returnflag <> 'N'").selectExpr(
        "l_orderkey AS page", "l_returnflag AS side", "row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS zone",
        "l_quantity AS center_x", "CAST(l_partkey AS DOUBLE) AS center_y", "l_linenumber AS height", "l_suppkey AS left", "2 * l_suppkey + 7 AS right", "l_partkey AS top", "l_partkey + l_linenumber AS bottom",
    )
    return compare.zones(rows.where("side = 'A'"), rows.where("side = 'R'"), "page")


@query(
    """WITH f AS (SELECT l_orderkey AS page, l_linenumber * 1000000 + l_partkey AS o, l_discount AS score, l_partkey % 500 AS x0, l_partkey % 400 AS y0, l_partkey % 500 + l_quantity::INTEGER * 7 AS x1, l_partkey % 400 + l_suppkey AS y1 FROM lineitem),
k AS (SELECT *, greatest(4, CAST(round_even(greatest(x1 - x0, y1 - y0) * 0.12::DOUBLE, 0) AS INTEGER)) AS m, row_number() OVER (PARTITION BY page ORDER BY score DESC, o) AS r FROM f WHERE x1 - x0 BETWEEN 20 AND 200 AND y1 - y0 BETWEEN 10 AND 160 AND score >= 0.03)
SELECT page, o, score, greatest(0, x0 - m) AS left_px, greatest(0, y0 - m) AS top_px, least(600, x1 + m) AS right_px, least(800, y1 + m) AS bottom_px FROM k WHERE r = 1"""
)
def best_template(spark, sf_dir):
    found = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS page", "l_linenumber * 1000000 + l_partkey AS o", "l_discount AS score", "l_partkey % 500 AS x0", "l_partkey % 400 AS y0", "l_partkey % 500 + int(l_quantity) * 7 AS x1", "l_partkey % 400 + l_suppkey AS y1")
    made = compare.best_template(found, "page", "o", "score", F.lit(600), F.lit(800), 0.03)
    return made.select("page", "o", "score", F.col("crop.x0").alias("left_px"), F.col("crop.y0").alias("top_px"), F.col("crop.x1").alias("right_px"), F.col("crop.y1").alias("bottom_px"))


@query("SELECT user_id, value, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) AS r FROM events WHERE value IS NOT NULL) WHERE r = 1")
def first_best(spark, sf_dir):
    return compare.first_best(table(spark, sf_dir, "events").select("user_id", "value", "event_id"), ["user_id"], ["value"], "event_id")


@query(
    """SELECT *, CAST(row_number() OVER (PARTITION BY o ORDER BY code, coalesce(resource, ''), position NULLS FIRST, detail) AS INTEGER) AS rank FROM (
  SELECT DISTINCT l_orderkey AS o, l_returnflag AS code, CASE WHEN l_suppkey % 2 = 0 THEN l_linestatus END AS resource, CASE WHEN l_partkey % 3 > 0 THEN l_linenumber END AS position, CAST(l_partkey % 2 AS VARCHAR) AS detail FROM lineitem)"""
)
def canonical_diagnostics(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_returnflag").alias("code"), F.when(F.col("l_suppkey") % 2 == 0, F.col("l_linestatus")).alias("resource"), F.when(F.col("l_partkey") % 3 > 0, F.col("l_linenumber")).alias("position"), (F.col("l_partkey") % 2).cast("string").alias("detail"))
    return compare.canonical(rows, ["o"], "code", "resource", "position", "detail")


@query(
    """WITH s(sample, weight, required) AS (VALUES (0, 1, true), (1, 2, true), (2, 4, false), (3, 8, false)),
b AS (SELECT l_suppkey AS family, l_partkey % 16 AS sample, max({'a': l_quantity / 64, 'b': l_linestatus, 'c': CAST(l_orderkey AS VARCHAR)}) AS v FROM lineitem WHERE l_partkey % 16 < 4 GROUP BY ALL),
o AS (SELECT family, sum(round(v.a, 6) * weight) / sum(weight) AS overall, max({'a': round(v.a, 6) * weight, 'b': v.b, 'c': v.c}) AS r FROM b JOIN s USING (sample) GROUP BY family HAVING count(*) FILTER (WHERE required) = 2)
SELECT family, r.b AS style, r.c AS path, round(overall, 6) AS overall, CAST(row_number() OVER (ORDER BY overall DESC, family, r.b, r.c) AS INTEGER) AS rank, CASE WHEN max(overall) OVER () >= 0.7 THEN 'matched' ELSE 'fallback_required' END AS status
FROM o ORDER BY overall DESC, family, style, path LIMIT 10"""
)
def ranked_families(spark, sf_dir):
    samples = spark.createDataFrame([(0, 1, True), (1, 2, True), (2, 4, False), (3, 8, False)], "sample long, weight int, required boolean")
    rows = table(spark, sf_dir, "lineitem").where("l_partkey % 16 < 4").select(F.col("l_suppkey").alias("family"), (F.col("l_partkey") % 16).alias("sample"), (F.col("l_quantity") / 64).alias("score"), F.col("l_linestatus").alias("style"), F.col("l_orderkey").cast("string").alias("path"))
    return compare.ranked_families(rows, samples, 0.7, 10)[0].withColumn("overall", F.round("overall", 6))


@query("SELECT user_id, event_type, CAST(round(sum(CAST(value AS DECIMAL(28, 9))), 6) AS DOUBLE) AS seconds FROM events GROUP BY ALL")
def stage_totals(spark, sf_dir):
    return compare.stage_totals(table(spark, sf_dir, "events"), ["user_id"], "event_type", "value")


@query("SELECT l_orderkey, CASE WHEN bool_and(l_tax > 0) THEN string_agg(l_returnflag, '' ORDER BY l_linenumber, l_partkey, l_returnflag) END AS text FROM lineitem GROUP BY l_orderkey")
def page_scalars(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("at", F.struct("l_linenumber", "l_partkey", "l_returnflag"))
    return scope.scalars(rows, "l_orderkey", "at", "l_returnflag", F.col("l_tax") > 0)


@query(
    """SELECT l_orderkey AS page, 'unknown' AS content_status, 'unknown' AS geometry_status, 'unknown' AS overall_status, CAST(0 AS BIGINT) AS matched_scan, count(*) FILTER (WHERE l_tax > 0.02) AS total_scan, CAST(0 AS BIGINT) AS matched_candidate,
count(*) FILTER (WHERE l_discount > 0.02) AS total_candidate, 'invalid-policy' AS code, 'text_confidence' AS field FROM lineitem WHERE l_tax > 0.02 OR l_discount > 0.02 GROUP BY l_orderkey"""
)
def invalid_policy(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "page")
    return scope.invalid_policy(rows.where("l_tax > 0.02"), rows.where("l_discount > 0.02"), "page", scope.invalid_field(1.0, 0.0, 1.5, None))


@query(
    """SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'text-claim-unknown' WHEN 1 THEN 'text-confidence-below-policy' WHEN 2 THEN 'ambiguous-text-match' WHEN 3 THEN 'ambiguous-text-match' ELSE 'unmatched-text' END AS parent,
CASE WHEN event_id % 6 = 0 THEN 'redacted' END AS reason, CASE event_id % 6 WHEN 0 THEN 'geometry-claim-unknown' WHEN 1 THEN 'geometry-confidence-below-policy' END AS geometry FROM events"""
)
def failure_diagnostics(spark, sf_dir):
    kinds = F.array(*[F.lit(x) for x in ("unknown:redacted", "below-policy", "ambiguous", "collision", "unmatched", None)])
    rows = table(spark, sf_dir, "events").select("event_id", F.get(kinds, (F.col("event_id") % 6).cast("int")).alias("f"))
    parent = scope.parent_diagnostic(F.col("f"))
    return rows.select("event_id", parent["code"].alias("parent"), parent["reason"].alias("reason"), scope.geometry_diagnostic(F.col("f"))["code"].alias("geometry"))


@query(
    """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN g THEN 'observed' ELSE 'unknown' END AS status, CASE WHEN g THEN 40::DOUBLE END AS ink_height_px, CASE WHEN g AND l_returnflag = 'A' THEN b END AS x_height_px, CASE WHEN g AND l_returnflag = 'R' THEN 40 - b END AS descender_depth_px
FROM (SELECT *, l_quantity + l_suppkey % 9 - 4 AS b, l_tax * 20 >= 0.5 AND l_quantity + l_suppkey % 9 - 4 BETWEEN 0 AND 40 AS g FROM lineitem)"""
)
def typographic_profile(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("b", F.col("l_quantity") + F.col("l_suppkey") % 9 - 4)
    box = lambda scale: F.struct(*[F.lit(float(v * scale)).alias(n) for n, v in zip(("x0", "y0", "x1", "y1"), (0, 0, 10, 40), strict=True)])
    features = F.struct((F.col("l_returnflag") == "A").alias("xheight"), (F.col("l_returnflag") == "N").alias("ascender"), (F.col("l_returnflag") == "R").alias("descender"))
    made = rules.typographic_profile(box(1), box(2), F.col("b"), F.col("b") * 2, F.col("l_tax") * 20, features)
    return rows.withColumn("p", made).select("l_orderkey", "l_linenumber", "l_partkey", "p.status", "p.ink_height_px", "p.x_height_px", "p.descender_depth_px")


LINES = """l AS (SELECT l_orderkey AS region, l_partkey AS line, l_linenumber, CAST(l_suppkey AS DOUBLE) AS x0, CAST(l_partkey AS DOUBLE) AS y0, CAST(l_suppkey + 200 AS DOUBLE) AS x1, CAST(l_partkey + 12 AS DOUBLE) AS y1, CAST(l_quantity AS INTEGER) AS gap, CASE WHEN l_tax > 0.01 THEN CAST(l_quantity AS INTEGER) + l_linenumber END AS start FROM lineitem)"""


def _lines(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS region", "l_partkey AS line", "l_linenumber", "CAST(l_suppkey AS DOUBLE) AS x0", "CAST(l_partkey AS DOUBLE) AS y0", "CAST(l_suppkey + 200 AS DOUBLE) AS x1", "CAST(l_partkey + 12 AS DOUBLE) AS y1", "int(l_quantity) AS gap", "CASE WHEN l_tax > 0.01 THEN int(l_quantity) + l_linenumber END AS start")


@query(
    f"""WITH {LINES}, m AS (SELECT region, round_even(median(x0), 0) AS e, count(*) AS n FROM l GROUP BY region),
r AS (SELECT *, coalesce(n >= 3 AND e - x0 > 15 AND gap >= 15 AND abs(x0 + start - e) <= 12, false) AS repaired FROM l JOIN m USING (region))
SELECT region, line, l_linenumber, repaired, CASE WHEN repaired THEN greatest(x0, x0 + start - 2) ELSE x0 END AS new_x0 FROM r"""
)
def repaired_lines(spark, sf_dir):
    return regions.repaired_lines(_lines(spark, sf_dir), ["region"], "gap", "start").select("region", "line", "l_linenumber", "repaired", "new_x0")


@query(
    f"""WITH {LINES}, b AS (SELECT region, min(x0) AS a, min(y0) AS b, max(x1) AS c, max(y1) AS d FROM l GROUP BY region), o AS (SELECT o_orderkey AS region, 3.0::DOUBLE AS x0 FROM orders)
SELECT region, coalesce(a, x0) AS x0, coalesce(b, 4) AS y0, coalesce(c, 5) AS x1, coalesce(d, 6) AS y1, a IS NOT NULL AS changed FROM o LEFT JOIN b USING (region)"""
)
def recomputed_boxes(spark, sf_dir):
    own = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("region"), *[F.lit(float(v)).alias(n) for n, v in zip(("x0", "y0", "x1", "y1"), (3, 4, 5, 6), strict=True)])
    return regions.recomputed_boxes(own, _lines(spark, sf_dir), ["region"])


@query("SELECT p_partkey, CASE WHEN p_size > 9 THEN p_size * 0.5::DOUBLE END AS left_pt, CASE WHEN p_size > 9 AND p_size <> 20 THEN p_size * 0.25::DOUBLE END AS first_y, CASE WHEN p_size BETWEEN 10 AND 30 THEN (30 - p_size) * 0.25::DOUBLE END AS baseline FROM part")
def scaled_nodes(spark, sf_dir):
    size = F.col("p_size").cast("double")
    box = F.struct(*[size.alias(n) for n in ("x0", "y0", "x1", "y1")])
    polygon = F.when(F.col("p_size") != 20, F.array(F.struct(size.alias("x"), size.alias("y"))))
    scale = F.when(F.col("p_size") > 9, F.struct(F.lit(0.5).alias("x"), F.lit(0.25).alias("y")))
    made = table(spark, sf_dir, "part").select("p_partkey", geometry.scaled_node(box, polygon, 30 - size, scale).alias("n"))
    return made.select("p_partkey", F.col("n.box.x0").alias("left_pt"), F.get("n.polygon", 0)["y"].alias("first_y"), F.col("n.baseline").alias("baseline"))


@query(
    """SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'unknown' WHEN p_size <> 25 THEN 'known' END AS status, CASE WHEN p_size % 3 > 0 AND p_size <> 25 THEN (2 * p_size + 1) / (0.04::DOUBLE * p_size - 1) END AS first_x,
CASE WHEN p_size % 3 = 0 THEN 'ambiguous' END AS reason, CASE WHEN p_size % 3 > 0 AND p_size <> 25 THEN 0.5::DOUBLE END AS confidence FROM part"""
)
def projected_claims(spark, sf_dir):
    size = F.col("p_size").cast("double")
    points = F.array(F.struct(size.alias("x"), F.lit(0.0).alias("y")))
    kind = "array<struct<x:double,y:double>>"
    claim = F.when(F.col("p_size") % 3 == 0, claims.unknown(kind, "ambiguous")).otherwise(claims.known(points.cast(kind), F.lit(0.5)))
    m = F.array(*[F.lit(float(v)) for v in (2, 0, 1, 0, 1, 0, 0.04, 0, -1)])
    made = table(spark, sf_dir, "part").select("p_partkey", geometry.project_claim(m, claim).alias("c"))
    return made.select("p_partkey", "c.status", F.get("c.value", 0)["x"].alias("first_x"), "c.reason", "c.confidence")


@query(
    """SELECT p_partkey, '{"schema":"s","schema_version":1,"status":"valid","scope":"contract-and-raster-identity","source":{"page_index":' || p_partkey || ',"raster_sha256":"' || p_name || '","media_type":"' || p_type || '","width_px":' || p_size || ',"height_px":7},"counts":{"units":1,"provenance_records":2,"diagnostics":3}}' AS json FROM part"""
)
def validation_report(spark, sf_dir):
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey", "p_partkey AS page_index", "p_name AS raster_sha256", "p_type AS media_type", "p_size AS width_px", "7 AS height_px", "1 AS units", "2 AS provenance_records", "3 AS diagnostics")
    return rows.select("p_partkey", reports.validation("s").alias("json"))


@query(
    """SELECT l_orderkey, CASE WHEN t = 0 THEN 'empty-scan-scope' WHEN a > 0 THEN 'content-not-preserved' WHEN m <> t THEN 'partial-coverage' WHEN f > 0 THEN 'unmatched-units' WHEN k IS NULL THEN 'missing-horizontal-evidence' END AS reason
FROM (SELECT l_orderkey, count(*) FILTER (WHERE l_tax > 0.01) AS t, count(*) FILTER (WHERE l_returnflag = 'A') AS a, count(*) FILTER (WHERE l_tax > 0.01 AND l_discount > 0) AS m, count(*) FILTER (WHERE l_linestatus = 'F') AS f, max(CASE WHEN l_quantity > 20 THEN l_quantity END) AS k FROM lineitem GROUP BY l_orderkey)"""
)
def trial_ineligible(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.expr("count_if(l_tax > 0.01)").alias("t"),
        F.expr("count_if(l_returnflag = 'A')").alias("a"),
        F.expr("count_if(l_tax > 0.01 AND l_discount > 0)").alias("m"),
        F.expr("count_if(l_linestatus = 'F')").alias("f"),
        F.max(F.when(F.col("l_quantity") > 20, F.col("l_quantity"))).alias("k"),
    )
    kept = F.when(F.col("a") > 0, status.UNKNOWN).otherwise(status.PRESERVED)
    return rows.select("l_orderkey", status.ineligible(F.col("t"), kept, F.col("m"), F.lit(1), F.lit(1), F.col("f"), F.col("k")).alias("reason"))


@query("SELECT l_orderkey, l_partkey AS glyph_index, l_suppkey AS code, l_quantity AS x, l_returnflag AS font FROM lineitem WHERE l_linenumber < 3")
def catalogue_round_trip(spark, sf_dir):
    """Glyphs written to catalogues, a JSON text a page, and read again."""
    glyphs = table(spark, sf_dir, "lineitem").where("l_linenumber < 3").select("l_orderkey", F.col("l_partkey").alias("glyph_index"), F.col("l_suppkey").alias("code"), F.col("l_quantity").alias("x"), F.lit(0.5).alias("y"), F.lit(1.5).alias("advance"), F.col("l_returnflag").alias("font"), F.lit(10.0).alias("size"))
    fonts = spark.createDataFrame([("A", "Alpha"), ("N", None)], "font string, base_font string")
    made = sinks.glyph_catalogue(glyphs, fonts, "l_orderkey")
    return content.catalogue_glyphs(made, "l_orderkey", "json").select("l_orderkey", "glyph_index", "code", "x", "font")
