"""Lines, tokens, files and formats of pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from platen.operators import fonts, pages

from .catalogue import query, table
from .line_queries import lines_of


@query(
    """SELECT l_orderkey, CASE WHEN bool_and(l_tax > 0) THEN string_agg(l_returnflag || CAST(l_linenumber AS VARCHAR), '' ORDER BY l_linenumber, l_returnflag, l_partkey) END AS text
FROM lineitem GROUP BY l_orderkey"""
)
def line_build(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_returnflag", "l_partkey").alias("at"), F.when(F.col("l_tax") > 0, F.concat("l_returnflag", F.col("l_linenumber").cast("string"))).alias("sign"))
    return pages.built_lines(rows, ["l_orderkey"], "at", "sign")


@query(
    r"""SELECT conv_id, turn, CAST(i AS INTEGER) AS line_no, l[i + 1] AS line, CAST(i + coalesce(list_sum(list_transform(l[1:i], lambda x: len(x))), 0) AS BIGINT) AS start,
  CASE WHEN i + 1 < len(l) THEN 'lf' ELSE 'none' END AS break_kind
FROM (SELECT conv_id, turn, l, unnest(range(0, len(l))) AS i FROM (SELECT conv_id, turn, string_split(text, chr(10)) AS l FROM conversations)) WHERE i + 1 < len(l) OR l[i + 1] <> ''"""
)
def derived_lines(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").withColumn("key", F.struct("conv_id", "turn"))
    return pages.derived_lines(rows, "key", "text").select("key.conv_id", "key.turn", "line_no", "line", "start", "break_kind")


@query(
    r"""SELECT conv_id, turn, kind, count(*) AS n, CAST(sum(len(t)) AS BIGINT) AS signs FROM (
  SELECT conv_id, turn, t, CASE WHEN regexp_matches(t, '^\s') THEN 'space' WHEN regexp_matches(t, '^[\p{L}\p{M}\p{N}_]') THEN 'word' ELSE 'sign' END AS kind
  FROM (SELECT conv_id, turn, unnest(regexp_extract_all(text, '\s+|[\p{L}\p{M}\p{N}_]+|[^\s\p{L}\p{M}\p{N}_]')) AS t FROM conversations)) GROUP BY ALL"""
)
def token_kinds(spark, sf_dir):
    made = pages.tokens(table(spark, sf_dir, "conversations"), ["conv_id", "turn"], "text")
    return made.groupBy("conv_id", "turn", "kind").agg(F.count("*").alias("n"), F.sum(F.length("token")).alias("signs"))


@query(
    """WITH l AS (SELECT item_id AS page, 'scan-' || CAST(item_id AS VARCHAR) || '.png' AS left_path FROM benchmark WHERE item_id % 3 > 0), r AS (SELECT item_id AS page, 'text-' || CAST(item_id AS VARCHAR) || '.json' AS right_path FROM benchmark WHERE item_id % 5 > 0)
SELECT coalesce(l.page, r.page) AS page, left_path, right_path, CASE WHEN left_path IS NULL THEN 'right-only' WHEN right_path IS NULL THEN 'left-only' ELSE 'ready' END AS state FROM l FULL JOIN r ON l.page = r.page"""
)
def page_discovery(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark")
    name = lambda head, tail: F.concat(F.lit(head), F.col("item_id").cast("string"), F.lit(tail)).alias("path")
    return pages.page_files(items.where("item_id % 3 > 0").select(name("scan-", ".png")), items.where("item_id % 5 > 0").select(name("text-", ".json")))


@query("SELECT user_id, event_type, min(event_id) AS first FROM events GROUP BY ALL")
def diagnostics_once(spark, sf_dir):
    return pages.once(table(spark, sf_dir, "events"), ["user_id"], "event_type", "event_id")


@query(
    """SELECT g, min(l) AS left_first, min(r) AS right_first, count(*) AS length FROM (
  SELECT g, l, r, l - r AS d, l - row_number() OVER (PARTITION BY g, l - r ORDER BY l) AS k FROM (SELECT DISTINCT c_nationkey AS g, c_custkey AS l, CAST(floor(c_acctbal) AS BIGINT) % 7 + c_custkey AS r FROM customer)) GROUP BY g, d, k"""
)
def contiguous_runs(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("g"), F.col("c_custkey").alias("l"), (F.floor("c_acctbal") % 7 + F.col("c_custkey")).alias("r")).distinct()
    return pages.diagonal_runs(rows, ["g"], "l", "r")


FORMATS = (("A", 20.0, 900.0), ("B", 30.0, 950.0), ("C", 30.0, 1000.0), ("D", 10.0, 980.0))


@query(
    """WITH f(name, w, h) AS (VALUES """
    + ", ".join(f"('{n}', CAST({w} AS DOUBLE), CAST({h} AS DOUBLE))" for n, w, h in FORMATS)
    + """), e AS (SELECT p_partkey, name, abs(p_size / w - 1) AS ew, abs(p_retailprice / h - 1) AS eh FROM part, f)
SELECT p_partkey, CASE WHEN arg_min(greatest(ew, eh), ROW(greatest(ew, eh), ew + eh, name)) <= 0.25 THEN arg_min(name, ROW(greatest(ew, eh), ew + eh, name)) END AS format FROM e GROUP BY p_partkey"""
)
def best_format(spark, sf_dir):
    formats = spark.createDataFrame(list(FORMATS), "name string, w double, h double")
    return pages.best_format(table(spark, sf_dir, "part"), formats, "p_partkey", F.col("p_size").cast("double"), F.col("p_retailprice"), 0.25)


@query("SELECT s_nationkey % 5 AS chapter, count(*) AS pages, sum(CASE WHEN s_acctbal < 0 THEN 1 ELSE 0 END)::BIGINT AS review FROM supplier GROUP BY 1")
def review_counts(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier")
    return rows.groupBy((F.col("s_nationkey") % 5).alias("chapter")).agg(F.count("*").alias("pages"), F.count_if(F.col("s_acctbal") < 0).alias("review"))


@query(None)
def region_grouping(spark, sf_dir):
    """Lines of a document as boxes, grouped into regions."""
    rows = lines_of(spark, sf_dir).select("doc_id", F.col("line_no").alias("line"), F.lit(0.0).alias("x0"), (F.col("line_no") * 12.0).alias("y0"), (F.length("line") * 6.0 + 1).alias("x1"), (F.col("line_no") * 12.0 + 10).alias("y1"))
    return pages.grouped_regions(rows, "doc_id").select("doc_id", "line", "region")


@query(
    """WITH a AS (SELECT l_suppkey, l_shipdate, min(l_orderkey) AS k FROM lineitem GROUP BY ALL), b AS (SELECT l_suppkey AS s, l_shipdate AS d, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL)
SELECT coalesce(l_suppkey, s) AS l_suppkey, count(*) AS days, count(n) AS returned FROM a FULL JOIN b ON l_suppkey = s AND l_shipdate = d GROUP BY 1"""
)
def cluster_zip(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    left = rows.groupBy("l_suppkey", "l_shipdate").agg(F.min("l_orderkey").alias("k"))
    right = rows.where("l_returnflag = 'R'").groupBy("l_suppkey", "l_shipdate").agg(F.count("*").alias("n"))
    return pages.by_index(left, right, ["l_suppkey", "l_shipdate"]).groupBy("l_suppkey").agg(F.count("*").alias("days"), F.count("n").alias("returned"))


@query(
    """WITH l AS (SELECT l_orderkey, CASE WHEN l_quantity > 3 THEN l_tax END AS r, l_tax - (l_discount - CAST(0.03 AS DOUBLE)) AS li, l_tax - (l_quantity / 500 - CAST(0.01 AS DOUBLE)) AS b, l_returnflag = 'A' AS it FROM lineitem),
g AS (SELECT l_orderkey, count(r) AS n, avg(CASE WHEN r IS NOT NULL THEN it::INT END) AS i, count(*) FILTER (WHERE r - li >= CAST(0.04 AS DOUBLE)) AS lv, count(*) FILTER (WHERE r - b >= CAST(0.04 AS DOUBLE)) AS bv,
  round(avg(r - li), 9) AS lm, round(avg(r - b), 9) AS bm FROM l GROUP BY l_orderkey), d AS (SELECT *, CASE WHEN n = 1 THEN 1 ELSE greatest(2, CAST(ceil(n * CAST(0.6 AS DOUBLE) - 1e-9) AS BIGINT)) END AS need FROM g)
SELECT l_orderkey, CASE WHEN n > 0 THEN CASE WHEN i >= 0.5 THEN 'italic' ELSE 'normal' END END AS slant,
  CASE WHEN n > 0 THEN CASE WHEN lv >= need AND (bv < need OR lm >= bm) THEN 'light' WHEN bv >= need THEN 'bold' ELSE 'regular' END END AS weight, n AS observed FROM d"""
)
def region_style(spark, sf_dir):
    tax, seen = F.col("l_tax"), F.col("l_quantity") > 3
    rows = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", (F.col("l_returnflag") == "A").cast("int").alias("italic"), F.when(seen, tax).alias("regular"), (tax - (F.col("l_discount") - 0.03)).alias("light"), (tax - (F.col("l_quantity") / 500 - 0.01)).alias("bold")
    )
    return fonts.style_consensus(rows, "l_orderkey", "italic", {"regular": "regular", "light": "light", "bold": "bold"})
