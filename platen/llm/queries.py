"""The queries of this package over the driver's tables, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, hmm, lines, packing, quality, quantise, simhash, toxicity, voronoi, warc
from .common import remainder, table


def op1_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = hmm.scores(table(spark, sf_dir, "documents"), remainder("doc_id", 5) != 1)
    return made.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op2_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return made.select("doc_id", "text", F.size("removed").cast("long").alias("n_removed"))


OP2_SQL = """
WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
w AS (SELECT doc_id, p, l[p + 1] AS a, l[p + 2] AS b, l[p + 3] AS c FROM (SELECT doc_id, l, unnest(range(0, len(l) - 2)) AS p FROM d)),
r AS (SELECT doc_id, p, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, p) AS n FROM w),
g AS (SELECT DISTINCT doc_id, p + o AS p FROM r, (SELECT unnest(range(0, 3)) AS o) WHERE n > 1),
x AS (SELECT doc_id, unnest(range(0, len(l))) AS p, unnest(l) AS line FROM d),
k AS (
  SELECT x.doc_id, string_agg(line, chr(10) ORDER BY x.p) FILTER (WHERE g.p IS NULL) AS kept, count(g.p) AS n
  FROM x LEFT JOIN g ON x.doc_id = g.doc_id AND x.p = g.p GROUP BY x.doc_id
)
SELECT d.doc_id, CASE WHEN k.n > 0 THEN coalesce(k.kept, '') ELSE d.text END AS text, coalesce(k.n, 0) AS n_removed
FROM documents d LEFT JOIN k ON d.doc_id = k.doc_id
"""


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end=2)
    return packing.digests(packed)


#: A text is taken as good from this score on.
GOOD = 0.7


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels").where(remainder("doc_id", 4) != 2))
    made = quality.score(docs, model)
    return made.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= GOOD).cast("int").alias("predicted"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    made = bpe.encode_decode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
    return made.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op6_quantised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantise.near_duplicates(table(spark, sf_dir, "embeddings"))


def op8_voronoi(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    rows = rows.select("vec_id", voronoi.whole_numbers(F.col("embedding")).alias("embedding"))
    return voronoi.top_k(rows, F.col("vec_id") % 50 == 0)


OP8_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, d.vec_id, CAST(list_dot_product(q.e, d.e) AS BIGINT) AS score
  FROM v q, v d WHERE q.vec_id % 50 = 0 AND d.vec_id <> q.vec_id
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 5
"""


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


OP7_SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS digest FROM pages
), f AS (SELECT digest, min(page_id) AS first_id FROM p WHERE n >= 100 GROUP BY digest)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
  CASE WHEN first_id IS NOT NULL AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first_id IS NOT NULL AND page_id <> first_id THEN first_id END AS refers_to
FROM p LEFT JOIN f USING (digest)
"""


#: A text is taken as toxic from this score on.
TOXIC = 0.7


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels").where(remainder("doc_id", 3) != 1))
    made = toxicity.score(docs, model)
    return made.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op")}


def oracle_sql() -> dict[str, str]:
    return {"op2_lines": OP2_SQL, "op7_warc": OP7_SQL, "op8_voronoi": OP8_SQL}
