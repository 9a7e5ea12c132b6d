"""Plans, layouts, features and evidence, on orders as pages and their items as lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from platen.functions import geometry as g
from platen.functions import rules
from platen.functions import text as t
from platen.functions.claims import gate
from platen.operators import layout, match, planning, regions

from .catalogue import query, table
from .line_queries import LINES, lines_of, sides

#: Halves both axes.
HALF = (0.5, 0.0, 0.0, 0.0, 0.5, 0.0, 0.0, 0.0, 1.0)
FIRST_ITEMS = "SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice) = 1"


def _items(spark, sf_dir):
    """An item for each order and line number. Items are dealt by order, which joins and groups by page then need not do again."""
    rows = table(spark, sf_dir, "lineitem").repartition("l_orderkey").groupBy("l_orderkey", "l_linenumber").agg(F.min(F.struct("l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus")).alias("x"))
    return rows.select(F.col("l_orderkey").alias("page"), "l_linenumber", "x.*")


def _pages(spark, sf_dir):
    matrix = F.when(F.col("o_orderstatus") != "P", F.array(*map(F.lit, HALF)))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("page"), matrix.alias("matrix"), F.lit(100.0).alias("width"), F.lit(200.0).alias("height"))


def _box(x0, x1, y):
    return F.struct(x0.alias("x0"), y.alias("y0"), x1.alias("x1"), (y + 10.0).alias("y1"))


@query(
    f"""WITH {LINES}, w AS (SELECT unit, line, CASE WHEN unit % 7 = 0 THEN 'unknown:ambiguous' WHEN unit % 10 < 2 THEN 'below-policy' END AS refused FROM obs WHERE regexp_matches(line, '[^ ]')),
k AS (SELECT line, count(*) AS n, min(unit) AS candidate FROM cand GROUP BY line), c AS (SELECT line, count(*) AS claims FROM w WHERE refused IS NULL GROUP BY line)
SELECT unit, CASE WHEN refused IS NULL AND n = 1 AND claims = 1 THEN candidate END AS candidate,
  CASE WHEN refused IS NOT NULL THEN refused WHEN n IS NULL THEN 'unmatched' WHEN n > 1 THEN 'ambiguous' WHEN claims > 1 THEN 'collision' END AS failure
FROM w LEFT JOIN k USING (line) LEFT JOIN c USING (line)"""
)
def parent_association(spark, sf_dir):
    """Parents are observed lines with a word; every seventh has no text, and low confidences fail the policy."""
    observed, candidates = sides(lines_of(spark, sf_dir))
    known = F.when(F.col("unit") % 7 == 0, "unknown").otherwise("known")
    claim = gate(known, (F.col("unit") % 10) / 10, F.lit("ambiguous"), 0.2)
    parents = observed.where(F.col("line").rlike("[^ ]")).select("unit")
    return match.parent_lines(parents, observed.select("unit", "line"), candidates.select("candidate", "line"), "unit", "line", "candidate", claim)


@query(
    """SELECT l_orderkey, CASE WHEN ok THEN x0 END AS x0, CASE WHEN ok THEN x1 END AS x1, CASE WHEN ok THEN m END AS baseline FROM (
  SELECT l_orderkey, min(least(x, x + a)) AS x0, max(greatest(x, x + a)) AS x1, median(y) AS m, bool_and(l_linenumber < 7) AS ok
  FROM (SELECT l_orderkey, l_linenumber, l_quantity AS x, l_discount * 100 - 5 AS a, l_tax * 100 AS y FROM lineitem) GROUP BY l_orderkey)"""
)
def candidate_geometry(spark, sf_dir):
    """The seventh glyph of a line has a baseline that isn't finite."""
    y = F.when(F.col("l_linenumber") < 7, F.col("l_tax") * 100).otherwise(F.lit(float("inf")))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_quantity").alias("x"), (F.col("l_discount") * 100 - 5).alias("a"), y.alias("y"))
    return regions.candidate_geometry(rows, ["l_orderkey"], "x", "a", "y")


@query(
    """SELECT p_partkey, CAST(g AS INTEGER) AS glyph, CAST(i AS INTEGER) AS place, unicode(substring(w, CAST(i + 1 AS BIGINT), 1)) AS code FROM (
  SELECT p_partkey, g, w, unnest(range(0, len(w))) AS i FROM (SELECT p_partkey, unnest(range(0, len(l))) AS g, unnest(l) AS w FROM (SELECT p_partkey, string_split(p_name, ' ') AS l FROM part)))"""
)
def codepoint_expansion(spark, sf_dir):
    glyphs = table(spark, sf_dir, "part").select("p_partkey", F.posexplode(F.split("p_name", " ")).alias("glyph", "text"))
    return regions.codepoints(glyphs, ["p_partkey"], "glyph", "text")


@query("SELECT c_nationkey, array_to_string(list(c_custkey ORDER BY c_custkey), ',') AS units FROM customer WHERE c_custkey % 9 > 0 GROUP BY c_nationkey, CAST(floor(c_acctbal / 100) AS BIGINT) HAVING count(*) > 1")
def ambiguous_order(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", F.when(F.col("c_custkey") % 9 > 0, F.array(F.floor(F.col("c_acctbal") / 100))).alias("key"))
    made = planning.ambiguous_orders(rows, ["c_nationkey"], "key", "c_custkey")
    return made.select("c_nationkey", F.array_join(F.col("units").cast("array<string>"), ",").alias("units"))


@query(
    """SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'N' THEN greatest(a, b, c) END AS residual, CASE WHEN l_returnflag <> 'A' THEN c END AS baseline FROM (
  SELECT l_orderkey, l_linenumber, l_returnflag, CAST(round_even(abs(l_discount - CAST(0.05 AS DOUBLE)) * 1024, 0) AS BIGINT) AS a, CAST(round_even(abs(l_tax) * 1024, 0) AS BIGINT) AS b, CAST(round_even(abs(l_quantity / 100) * 1024, 0) AS BIGINT) AS c FROM lineitem)"""
)
def evidence_residuals(spark, sf_dir):
    flag, there = F.col("l_returnflag"), F.col("l_returnflag") != "A"
    status = F.when(flag == "N", "violated").otherwise("unknown")
    given = lambda x: F.when(there, x)
    found = regions.horizontal_residual(status, given(F.col("l_discount") - 0.05), given(F.col("l_tax")), given(F.col("l_quantity") / 100))
    base = regions.baseline_residual(F.when(there, "preserved").otherwise("unknown"), given(F.col("l_quantity") / 100))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", found.alias("residual"), base.alias("baseline"))


@query(
    f"""WITH i AS ({FIRST_ITEMS}), u AS (SELECT o_orderkey AS page, o_orderstatus <> 'P' AS mapped, l_linenumber, l_returnflag = 'A' AS no_text, l_tax = 0 AS no_key, l_discount = 0 AS no_box, l_linenumber = 6 AS split, l_discount * 100 = 2 AS flat,
  CAST(l_tax * 100 AS BIGINT) AS key FROM orders JOIN i ON l_orderkey = o_orderkey),
d AS (SELECT *, mapped AND NOT (no_text OR no_key OR no_box) AS whole FROM u), p AS (SELECT *, whole AND NOT split AND NOT flat AS good FROM d),
s AS (SELECT page, count(*) AS shared FROM (SELECT page, key FROM p WHERE good GROUP BY page, key HAVING count(*) > 1) GROUP BY page),
t AS (SELECT page, count(*) AS total, count(*) FILTER (WHERE good) AS planned, count(*) FILTER (WHERE mapped AND no_text) + count(*) FILTER (WHERE mapped AND no_key) + count(*) FILTER (WHERE mapped AND no_box) AS lacking,
  count(*) FILTER (WHERE whole AND split) AS breaks, count(*) FILTER (WHERE whole AND NOT split AND flat) AS failed FROM p GROUP BY page)
SELECT o_orderkey AS page, CASE WHEN total > 0 AND o_orderstatus <> 'P' AND lacking + breaks + failed + coalesce(shared, 0) = 0 THEN 'materializable' ELSE 'unknown' END AS status,
  coalesce(planned, 0) AS planned, coalesce(total, 0) AS total, CASE WHEN total IS NULL OR o_orderstatus = 'P' THEN 1 ELSE lacking + breaks + failed + coalesce(shared, 0) END AS diagnostics
FROM orders LEFT JOIN t ON t.page = o_orderkey LEFT JOIN s ON s.page = o_orderkey"""
)
def line_plan(spark, sf_dir):
    """Lines lack their text, box or order now and then, hold a line end, have no width or share an order."""
    items = _items(spark, sf_dir)
    text = F.when(F.col("l_linenumber") == 6, F.lit("a\nb")).otherwise(F.col("l_linestatus"))
    box = _box(F.col("l_quantity"), F.col("l_quantity") + F.col("l_discount") * 100 - 2, F.col("l_linenumber") * 12.0)
    baseline = F.when(F.col("l_linenumber") % 2 == 0, F.array(F.struct(F.lit(0.0).alias("x"), F.lit(1.0).alias("y")), F.struct(F.lit(5.0).alias("x"), F.lit(1.0).alias("y"))))
    lines = items.select(
        "page", F.col("l_linenumber").alias("unit"), F.when(F.col("l_returnflag") != "A", text).alias("text"), F.when(F.col("l_discount") != 0, box).alias("box"),
        F.when(F.col("l_tax") != 0, F.array(F.round(F.col("l_tax") * 100).cast("long"))).alias("key"), baseline.alias("baseline"),
    )
    made = planning.line_plans(_pages(spark, sf_dir).select("page", "matrix"), lines, "page")
    return made.select("page", "status", "planned", "total", F.size("diagnostics").cast("long").alias("diagnostics"))


@query(
    f"""WITH i AS ({FIRST_ITEMS}), t AS (SELECT l_orderkey, count(*) AS lines, count(*) FILTER (WHERE l_tax = 0) AS without, min(l_quantity / 2) AS x0, min(l_linenumber * 6) AS y0, max((l_quantity + 20) / 2) AS x1, max((l_linenumber * 12 + 10) / 2) AS y1 FROM i GROUP BY l_orderkey),
r AS (SELECT o_orderkey AS page, coalesce(lines, 0) AS lines, CASE WHEN o_orderstatus = 'P' THEN 'page-mapping-unknown' WHEN lines IS NULL THEN 'no-lines' WHEN without > 0 THEN 'incomplete-line-bbox' END AS reason, x0, y0, x1, y1 FROM orders LEFT JOIN t ON l_orderkey = o_orderkey)
SELECT page, lines, reason, CASE WHEN reason IS NULL THEN CAST(y0 AS DOUBLE) END AS inset_top, CASE WHEN reason IS NULL THEN x0 END AS inset_left, CASE WHEN reason IS NULL THEN 100 - x1 END AS inset_right, CASE WHEN reason IS NULL THEN 200 - CAST(y1 AS DOUBLE) END AS inset_bottom FROM r"""
)
def page_layout(spark, sf_dir):
    lines = _items(spark, sf_dir).select("page", F.when(F.col("l_tax") != 0, _box(F.col("l_quantity"), F.col("l_quantity") + 20, F.col("l_linenumber") * 12.0)).alias("box"))
    return planning.page_layout(_pages(spark, sf_dir), lines, "page").select("page", "lines", "reason", "inset_top", "inset_left", "inset_right", "inset_bottom")


@query(
    f"""WITH i AS ({FIRST_ITEMS}), p AS (SELECT l_orderkey AS page, l_returnflag AS region, l_linenumber AS ord, l_quantity / 2 AS x0, CAST(l_linenumber * 12 AS DOUBLE) / 2 AS y0, (l_quantity + 20) / 2 AS x1, CAST(l_linenumber * 12 + 10 AS DOUBLE) / 2 AS y1, l_tax = 0 AS bare, l_tax = 0.08 AS loose FROM i),
g AS (SELECT page, region, count(*) AS lines, bool_or(loose) AS loose, bool_or(bare) AS bare, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, arg_min(x0, ord) AS start, max(gap) AS gap, min(CASE region WHEN 'A' THEN 2 WHEN 'N' THEN 1 END) AS ro
  FROM (SELECT *, lead(y0) OVER (PARTITION BY page, region ORDER BY ord) - y1 AS gap FROM p) GROUP BY page, region),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY page ORDER BY ro IS NULL, ro, region) - 1 AS INTEGER) AS place, CASE WHEN o_orderstatus = 'P' THEN 'page-mapping-unknown' WHEN loose THEN 'incomplete-line-reading-order' WHEN bare THEN 'incomplete-line-bbox' END AS reason FROM g JOIN orders ON o_orderkey = page)
SELECT page, region, place, lines, reason, CASE WHEN reason IS NULL THEN x0 END AS x0, CASE WHEN reason IS NULL THEN y0 END AS y0, CASE WHEN reason IS NULL THEN x1 END AS x1, CASE WHEN reason IS NULL THEN y1 END AS y1,
  CASE WHEN reason IS NULL THEN start END AS start, CASE WHEN reason IS NULL THEN gap END AS largest_gap FROM r"""
)
def region_layout(spark, sf_dir):
    """Items of one flag are a region; returned ones have no order of their own."""
    items = _items(spark, sf_dir).join(_pages(spark, sf_dir).select("page"), "page", "left_semi")
    lines = items.select(
        "page", F.col("l_returnflag").alias("region"), F.col("l_linenumber").alias("line"), F.when(F.col("l_tax") != 0.08, F.col("l_linenumber")).alias("ord"),
        F.when(F.col("l_tax") != 0, _box(F.col("l_quantity"), F.col("l_quantity") + 20, F.col("l_linenumber") * 12.0)).alias("box"),
    )
    order = F.when(F.col("region") == "A", 2).when(F.col("region") == "N", 1)
    every = lines.select("page", "region").distinct().withColumn("ord", order)
    made = planning.region_layout(_pages(spark, sf_dir), every, lines, "page")
    return made.select("page", "region", "place", "lines", "reason", "x0", "y0", "x1", "y1", F.get("starts", 0).alias("start"), F.array_max("gaps").alias("largest_gap"))


@query("SELECT c_custkey, CAST(row_number() OVER (PARTITION BY c_mktsegment ORDER BY coalesce(CASE WHEN c_nationkey % 5 > 0 THEN c_nationkey END, 0), (CASE WHEN c_custkey % 4 > 0 THEN floor(c_acctbal) END) IS NULL, CASE WHEN c_custkey % 4 > 0 THEN floor(c_acctbal) END, c_custkey) - 1 AS INTEGER) AS place FROM customer")
def unit_order(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_mktsegment", "c_custkey", F.when(F.col("c_nationkey") % 5 > 0, F.col("c_nationkey")).alias("up"), F.when(F.col("c_custkey") % 4 > 0, F.floor("c_acctbal")).alias("ord"))
    return planning.unit_order(rows, ["c_mktsegment"], "up", "ord", "c_custkey").select("c_custkey", "place")


@query(
    """WITH d AS (SELECT l_orderkey, CASE WHEN l_discount = 0.1 THEN 'face_mismatch' WHEN l_tax = 0 THEN 'unmapped_glyph' WHEN l_tax = 0.01 THEN 'opaque_font_model' END AS code FROM lineitem)
SELECT o_orderkey, CASE WHEN count(code) = 0 THEN 'preserved' WHEN bool_or(code = 'face_mismatch') THEN 'violated' ELSE 'unknown' END AS status, coalesce(array_to_string(list(DISTINCT code ORDER BY code) FILTER (WHERE code IS NOT NULL), ','), '') AS codes
FROM orders LEFT JOIN d ON l_orderkey = o_orderkey GROUP BY o_orderkey"""
)
def attestation(spark, sf_dir):
    code = F.when(F.col("l_discount") == 0.1, "face_mismatch").when(F.col("l_tax") == 0, "unmapped_glyph")
    items = table(spark, sf_dir, "lineitem")
    model = items.where("l_tax IN (0.01, 0.02) AND l_discount <> 0.1").select(F.col("l_orderkey").alias("o_orderkey"), F.when(F.col("l_tax") == 0.01, "opaque_font_model").otherwise("NoWidths").alias("code"))
    found = planning.opaque(model, items.select(F.col("l_orderkey").alias("o_orderkey"), code.alias("code")).where("code IS NOT NULL"), "code")
    made = planning.attested(table(spark, sf_dir, "orders"), found, "o_orderkey", "code")
    return made.select("o_orderkey", "status", F.array_join("codes", ",").alias("codes"))


@query(
    """WITH l AS (SELECT l_orderkey, CAST(l_linenumber AS DOUBLE) AS x0, l_linenumber + l_quantity AS x1 FROM lineitem), m AS (SELECT l_orderkey, count(*) AS n, median(x1 - x0) AS middle, max(x1 - x0) AS widest, stddev_pop(x1 - x0) AS spread, median(x0) AS lft, max(x0) - min(x0) AS ls FROM l GROUP BY l_orderkey),
r AS (SELECT o_orderkey, o_custkey, CAST(o_orderkey % 97 * 40 AS DOUBLE) AS y0, CAST(o_orderkey % 97 * 40 + 25 AS DOUBLE) AS y1 FROM orders), s AS (SELECT *, y0 - lag(y1) OVER w AS before_, lead(y0) OVER w - y1 AS after_ FROM r WINDOW w AS (PARTITION BY o_custkey ORDER BY y0, o_orderkey))
SELECT o_custkey, o_orderkey, coalesce(n, 0) AS line_count, round(coalesce(middle, 0) / 100, 4) AS median_line_width_ratio, round(coalesce(widest, 0) / 100, 4) AS maximum_line_width_ratio, round(coalesce(spread, 0) / 100, 4) AS line_width_variation_ratio,
  round(lft / 100, 4) AS left_margin_ratio, round(ls / 100, 4) AS left_margin_spread_ratio, round(y0 / 5000, 4) AS top_ratio, round(y1 / 5000, 4) AS bottom_ratio,
  CASE WHEN before_ IS NOT NULL THEN round(greatest(0, before_) / 5000, 4) END AS space_before_ratio, CASE WHEN after_ IS NOT NULL THEN round(greatest(0, after_) / 5000, 4) END AS space_after_ratio
FROM s LEFT JOIN m ON l_orderkey = o_orderkey"""
)
def region_features(spark, sf_dir):
    """A customer's orders are the regions of a page."""
    top = (F.col("o_orderkey") % 97 * 40).cast("double")
    every = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.lit(0.0).alias("x0"), top.alias("y0"), F.lit(100.0).alias("x1"), (top + 25).alias("y1"), F.lit(100.0).alias("width"), F.lit(5000.0).alias("height"))
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").cast("double").alias("x0"), (F.col("l_linenumber") + F.col("l_quantity")).alias("x1"))
    lines = items.join(every.select("o_orderkey", "o_custkey"), "o_orderkey")
    return regions.region_features(every, lines, "o_custkey", "o_orderkey", "width", "height")


@query("SELECT user_id, count(*) AS steps, median(d) AS leading FROM (SELECT user_id, lead(value) OVER (PARTITION BY user_id ORDER BY event_id) - value AS d FROM events WHERE value IS NOT NULL) WHERE d > 0 GROUP BY user_id")
def baseline_leading(spark, sf_dir):
    return layout.leading(table(spark, sf_dir, "events").where("value IS NOT NULL"), ["user_id"], "event_id", "value")


@query("SELECT user_id, count(*) AS mutations, count(*) FILTER (WHERE value > 50) AS found, avg(CASE WHEN value > 50 THEN 1.0::DOUBLE ELSE 0 END) AS score FROM events WHERE value IS NOT NULL GROUP BY user_id")
def mutation_score(spark, sf_dir):
    return regions.detection_rate(table(spark, sf_dir, "events").where("value IS NOT NULL"), ["user_id"], F.col("value") > 50)


@query("SELECT s_nationkey, array_to_string(list_filter(['train', 'validation'], lambda x: NOT list_contains(list(CASE s_suppkey % 3 WHEN 0 THEN 'validation' ELSE 'train' END), x)), ',') AS missing FROM supplier GROUP BY s_nationkey HAVING count(DISTINCT CASE s_suppkey % 3 WHEN 0 THEN 'validation' ELSE 'train' END) < 2")
def corpus_splits(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").withColumn("split", F.when(F.col("s_suppkey") % 3 == 0, "validation").otherwise("train"))
    return regions.missing_splits(rows, ["s_nationkey"], "split").select("s_nationkey", F.array_join("missing", ",").alias("missing"))


@query(
    """SELECT l_orderkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice) - 1 AS INTEGER) AS id, l_partkey AS text, l_discount AS score FROM lineitem"""
)
def detector_lines(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_extendedprice", "l_discount"))).alias("x"))
    rows = rows.select("l_orderkey", F.transform("x", lambda v: v["l_partkey"]).alias("text"), F.transform("x", lambda v: v["l_discount"]).alias("score"))
    return regions.zipped_arrays(rows, "l_orderkey", ["text", "score"])


@query(
    """WITH o AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey % 50 END AS ord, o_totalprice FROM orders), d AS (SELECT o_custkey, ord, arg_max(o_totalprice, o_orderkey) AS score FROM o WHERE o_orderkey % 2 = 0 AND ord IS NOT NULL GROUP BY ALL)
SELECT o.o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o.o_custkey ORDER BY o.ord IS NULL, o.ord, o_orderkey) - 1 AS INTEGER) AS place, score FROM o LEFT JOIN d ON d.o_custkey = o.o_custkey AND d.ord = o.ord"""
)
def ordered_regions(spark, sf_dir):
    blocks = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderkey") % 50).alias("ord"), F.col("o_totalprice").alias("score"))
    made = regions.ordered_regions(blocks.drop("score"), blocks.where("o_orderkey % 2 = 0"), "o_custkey", "ord", "o_orderkey", "score")
    return made.select("o_custkey", "o_orderkey", "place", "score")


@query(
    """SELECT p_partkey, CAST(s AS INTEGER) AS segment, kind, part, box FROM (
  SELECT p_partkey, 0 AS s, 'text' AS kind, p_name || chr(10) AS part, NULL AS box FROM part UNION ALL SELECT p_partkey, 1, 'visual', '<img src="images/bbox_1_2_' || p_size || '_40.jpg" />', '1,2,' || p_size || ',40' FROM part
  UNION ALL SELECT p_partkey, 2, 'visual', '<IMG src=''images/bbox_5_6_7_8.png''>', '5,6,7,8' FROM part WHERE p_size % 2 = 0 UNION ALL SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 3 ELSE 2 END, 'text', ' <img src="other.png"> end', NULL FROM part)"""
)
def image_segments(spark, sf_dir):
    size = F.col("p_size").cast("string")
    text = F.concat("p_name", F.lit('\n<img src="images/bbox_1_2_'), size, F.lit('_40.jpg" />'), F.when(F.col("p_size") % 2 == 0, "<IMG src='images/bbox_5_6_7_8.png'>").otherwise(""), F.lit(' <img src="other.png"> end'))
    made = regions.tagged_segments(table(spark, sf_dir, "part").select("p_partkey", text.alias("text")), ["p_partkey"], "text")
    return made.select("p_partkey", "segment", "kind", "part", F.array_join(F.col("box").cast("array<string>"), ",").alias("box"))


@query(
    """WITH b AS (SELECT s_nationkey, s_suppkey, s_acctbal AS y0, s_suppkey % 30 AS w FROM supplier), t AS (SELECT s_nationkey, count(*) AS n, count(*) FILTER (WHERE w >= 12 OR y0 >= 8500) AS wide FROM b GROUP BY 1), l AS (SELECT *, CASE WHEN s_nationkey % 2 = 0 THEN n ELSE wide END - CASE WHEN s_nationkey % 5 = 0 THEN 1 ELSE 0 END AS lines FROM t)
SELECT s_suppkey, CASE WHEN n = lines THEN 'text' WHEN wide = lines THEN CASE WHEN w >= 12 OR y0 >= 8500 THEN 'text' ELSE 'visual' END END AS kind FROM b JOIN l USING (s_nationkey)"""
)
def ink_bands(spark, sf_dir):
    wide = (F.col("x1") >= 12) | (F.col("y0") >= 8500)
    bands = table(spark, sf_dir, "supplier").select("s_nationkey", "s_suppkey", F.lit(0).alias("x0"), F.col("s_acctbal").alias("y0"), (F.col("s_suppkey") % 30).alias("x1"))
    n = F.when(F.col("s_nationkey") % 2 == 0, F.count("*")).otherwise(F.count_if(wide)) - F.when(F.col("s_nationkey") % 5 == 0, 1).otherwise(0)
    texts = bands.groupBy("s_nationkey").agg(n.alias("lines")).withColumn("width", F.lit(100.0)).withColumn("height", F.lit(10000.0))
    return regions.ink_bands(bands, texts, "s_nationkey").select("s_suppkey", "kind")


@query(
    """WITH g AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, role AS font, turn // 3 AS y, (turn // 2) % 2 = 0 AS rtl, turn % 11 = 10 AS ltr FROM conversations),
r AS (SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY n) AS run FROM (SELECT *, CASE WHEN n > 1 AND font = lag(font) OVER w AND y = lag(y) OVER w THEN 0 ELSE 1 END AS new FROM g WINDOW w AS (PARTITION BY conv_id ORDER BY n)))
SELECT conv_id, turn, CAST(CASE WHEN bool_or(rtl) OVER u AND NOT bool_or(ltr) OVER u THEN min(n) OVER u + max(n) OVER u - n ELSE n END - 1 AS INTEGER) AS place FROM r WINDOW u AS (PARTITION BY conv_id, run)"""
)
def logical_glyphs(spark, sf_dir):
    """Turns as glyphs of Hebrew or Latin letters."""
    text = F.concat(F.when(F.floor(F.col("turn") / 2) % 2 == 0, "שלום").otherwise("12"), F.when(F.col("turn") % 11 == 10, "a").otherwise(""))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("role").alias("font"), F.floor(F.col("turn") / 3).alias("y"), t.directions(text).alias("d"))
    return regions.logical_glyphs(rows, ["conv_id"], "turn", "font", "y", F.col("d.left"), F.col("d.right")).select("conv_id", "turn", "place")


@query("SELECT p_partkey, x0, y0, x1, y1 FROM (SELECT p_partkey, unnest([{'x0': 0, 'y0': 0, 'x1': p_size // 2, 'y1': 10}, {'x0': p_size // 2, 'y0': 0, 'x1': p_size, 'y1': 10}, {'x0': 0, 'y0': 10, 'x1': p_size // 2, 'y1': 21}, {'x0': p_size // 2, 'y0': 10, 'x1': p_size, 'y1': 21}], recursive := true) FROM part)".replace("'x0': 0,", "'x0': 0::BIGINT,").replace("'y0': 0,", "'y0': 0::BIGINT,").replace("'x1': p_size,", "'x1': p_size::BIGINT,").replace("p_size // 2", "(p_size // 2)::BIGINT").replace("'y0': 10,", "'y0': 10::BIGINT,").replace("'y1': 10}", "'y1': 10::BIGINT}").replace("'y1': 21}", "'y1': 21::BIGINT}"))
def page_quadrants(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.inline(g.quadrants(F.col("p_size"), F.lit(21))))


#: Requests for a face, and why some can't be used.
@query("SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN 'empty-font-family' WHEN s_acctbal <= 0 THEN 'invalid-font-size' WHEN s_suppkey % 5 = 0 THEN 'invalid-tracking' END AS fault FROM supplier")
def typography_faults(spark, sf_dir):
    family = F.when(F.col("s_suppkey") % 4 == 0, " \t").otherwise("Foo")
    tracking = F.when(F.col("s_suppkey") % 5 == 0, float("nan")).otherwise(0.0)
    return table(spark, sf_dir, "supplier").select("s_suppkey", rules.typography_fault(family, F.col("s_acctbal"), tracking).alias("fault"))
