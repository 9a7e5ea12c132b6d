"""Keys, references, orders, cycles, ranges, markup."""

from __future__ import annotations

from pyspark.sql import functions as F

from platen.functions import text as t
from platen.operators import match, validate

from .catalogue import query, table


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def pk_violations(spark, sf_dir):
    return validate.duplicate_keys(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def fk_violations(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return validate.dangling(rows, "l_orderkey", table(spark, sf_dir, "orders").where("o_orderstatus = 'F'"), "o_orderkey").select("l_orderkey", "l_linenumber", "l_partkey")


@query("SELECT c_mktsegment, coalesce(CAST(CASE WHEN c_custkey % 4 > 0 THEN c_nationkey END AS VARCHAR), '') AS siblings, CAST(floor(c_acctbal / 100) AS BIGINT) AS ord, count(*) AS n FROM customer GROUP BY ALL HAVING count(*) > 1")
def sibling_order_dupes(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_mktsegment", F.when(F.col("c_custkey") % 4 > 0, F.col("c_nationkey")).alias("parent"), F.floor(F.col("c_acctbal") / 100).alias("ord"))
    return validate.sibling_order(rows, ["c_mktsegment"], "parent", "ord")


@query(
    """WITH RECURSIVE e AS (SELECT c_custkey AS node, CASE WHEN c_custkey % 5 > 0 THEN (c_custkey * 3 + 1) % (SELECT count(*) FROM customer) END AS up FROM customer),
ok AS (SELECT node FROM e WHERE up IS NULL UNION SELECT e.node FROM e JOIN ok ON e.up = ok.node)
SELECT node FROM e WHERE node NOT IN (SELECT node FROM ok)"""
)
def parent_cycles(spark, sf_dir):
    rows = table(spark, sf_dir, "customer")
    n = rows.count()
    edges = rows.select(F.col("c_custkey").alias("node"), F.when(F.col("c_custkey") % 5 > 0, (F.col("c_custkey") * 3 + 1) % n).alias("up"))
    return validate.cyclic(edges, "node", "up")


@query(
    """SELECT n_nationkey AS unit_id, CAST(r_regionkey AS VARCHAR) || '.' || CAST(n_nationkey AS VARCHAR) AS reading_key FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT 1000 + r_regionkey, CAST(r_regionkey AS VARCHAR) FROM region"""
)
def hierarchy_keys(spark, sf_dir):
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("unit_id"), (F.col("n_regionkey") + 1000).alias("parent_id"), F.col("n_nationkey").alias("ord"))
    regions = table(spark, sf_dir, "region").select((F.col("r_regionkey") + 1000).alias("unit_id"), F.lit(None).cast("int").alias("parent_id"), F.col("r_regionkey").alias("ord"))
    made = match.hierarchy_keys(nations.union(regions))
    return made.select("unit_id", F.array_join(F.col("reading_key").cast("array<string>"), ".").alias("reading_key"))


@query(
    """SELECT conv_id, bool_and(turn = coalesce(p, -1) + 1) AND max(turn) + 1 = max(n) AS covers
FROM (SELECT conv_id, turn, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS p, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations) GROUP BY conv_id"""
)
def chapter_cover(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    total = rows.groupBy("conv_id").agg(F.count("*").alias("total"))
    ranges = rows.join(total, "conv_id").select("conv_id", (F.col("turn") + 1).alias("start"), (F.col("turn") + 1).alias("stop"), "total")
    return validate.contiguous(ranges, ["conv_id"], "start", "stop", "total")


CHECKS = [("empty-text", "text IS NULL OR length(text) = 0"), ("wrong-length", "n_chars <> length(text)"), ("no-source", "source IS NULL OR source = 'src0'"), ("foreign", "lang <> 'en'")]


@query("SELECT doc_id, CASE " + " ".join(f"WHEN {c} THEN '{n}'" for n, c in CHECKS) + " END AS violation FROM documents")
def first_violation(spark, sf_dir):
    return validate.first_violation(table(spark, sf_dir, "documents"), "doc_id", CHECKS)


@query(
    """SELECT l_orderkey, CASE WHEN bool_or(l_returnflag = 'R') THEN 'image-only' ELSE 'no-text' END AS diagnosis FROM lineitem GROUP BY l_orderkey HAVING NOT bool_or(l_returnflag = 'A')"""
)
def page_diagnosis(spark, sf_dir):
    operator = F.when(F.col("l_returnflag") == "A", "Tj").when(F.col("l_returnflag") == "R", "Do").otherwise("q")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", operator.alias("operator"), F.lit("Image").alias("kind"))
    return validate.page_diagnosis(rows, "l_orderkey", "operator", "kind")


@query("SELECT page_id, unnest(range(0, len(m))) AS segment, unnest(m) AS tag FROM (SELECT page_id, regexp_extract_all(html, '<(h[1-6]|p|li|td)[ >]', 1) AS m FROM pages WHERE html IS NOT NULL)")
def markup_segments(spark, sf_dir):
    tags = F.regexp_extract_all("html", F.lit("<(h[1-6]|p|li|td)[ >]"), 1)
    return table(spark, sf_dir, "pages").select("page_id", F.posexplode(tags).alias("segment", "tag")).select("page_id", F.col("segment").cast("long").alias("segment"), "tag")


@query(
    r"""SELECT page_id, md5(array_to_string(regexp_extract_all(replace(replace(lower(regexp_replace(regexp_replace(regexp_replace(html, '(?i)<img\b[^>]*>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '(?m)^[#>*+\-]+\s*', '', 'g')), 'ß', 'ss'), 'ς', 'σ'),
  '[\p{L}\p{N}_]+(?:[''’][\p{L}\p{N}_]+)?'), ' ')) AS text_md5 FROM pages"""
)
def text_normalize(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5(t.normalised(F.col("html"))).alias("text_md5"))


@query(
    """WITH c AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rank, turn FROM conversations WHERE role = 'user'),
a AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rank, turn FROM conversations WHERE role = 'assistant')
SELECT coalesce(c.conv_id, a.conv_id) AS conv_id, CAST(coalesce(c.rank, a.rank) AS INTEGER) AS rank, c.turn AS asked, a.turn AS answered FROM c FULL JOIN a ON c.conv_id = a.conv_id AND c.rank = a.rank"""
)
def ranked_pairs(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    asked = rows.where("role = 'user'").select("conv_id", F.col("turn").alias("asked"), F.col("turn").alias("at"))
    answered = rows.where("role = 'assistant'").select("conv_id", F.col("turn").alias("answered"), F.col("turn").alias("at"))
    return match.ranked_pairs(asked, answered, ["conv_id"], "at", "asked", "answered")


@query(
    """WITH d AS (SELECT conv_id, turn AS l, NULL AS r FROM conversations WHERE role = 'user'), u AS (SELECT conv_id, turn // 2 AS i, turn AS asked FROM conversations WHERE role = 'user'),
v AS (SELECT conv_id, turn // 2 AS i, turn AS answered FROM conversations WHERE role = 'assistant'), k AS (SELECT conv_id FROM conversations GROUP BY conv_id HAVING count(*) FILTER (WHERE role = 'user') = count(*) FILTER (WHERE role = 'assistant'))
SELECT u.conv_id, u.i, asked, answered FROM u JOIN v ON u.conv_id = v.conv_id AND u.i = v.i WHERE u.conv_id IN (SELECT conv_id FROM k)"""
)
def zipped_if_equal(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").withColumn("i", F.floor(F.col("turn") / 2))
    asked = rows.where("role = 'user'").select("conv_id", "i", F.col("turn").alias("asked"))
    answered = rows.where("role = 'assistant'").select("conv_id", "i", F.col("turn").alias("answered"))
    return match.zipped_if_equal(asked, answered, "conv_id", "i", "asked", "answered")
