"""Ink on small rasters: vectors of 64 components as 8 by 8 places."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from platen.operators import raster

from .catalogue import query, table

PLACES = """p AS (SELECT vec_id, CAST(i % 8 AS INTEGER) AS x, CAST(i // 8 AS INTEGER) AS y FROM (SELECT vec_id, embedding, unnest(range(0, 64)) AS i FROM embeddings WHERE len(embedding) = 64)
  WHERE least(255, greatest(0, floor(128 + 64 * CAST(embedding[i + 1] AS DOUBLE)))) < 120)"""
INK = 120


def _rasters(spark, sf_dir):
    grey = F.transform("embedding", lambda x: F.least(F.lit(255), F.greatest(F.lit(0), F.floor(128 + 64 * x.cast("double")))))
    pixels = F.unhex(F.array_join(F.transform(grey, lambda v: F.lpad(F.hex(v), 2, "0")), ""))
    return table(spark, sf_dir, "embeddings").where("size(embedding) = 64").select("vec_id", F.lit(8).alias("width"), F.lit(8).alias("height"), pixels.alias("pixels"))


@query(f"WITH {PLACES} SELECT vec_id, min(x) AS x0, min(y) AS y0, max(x) + 1 AS x1, max(y) + 1 AS y1, count(*) AS area FROM p GROUP BY vec_id")
def raster_ink(spark, sf_dir):
    def run(grey: np.ndarray) -> list[dict]:
        box = raster.ink_box(grey < INK)
        return [dict(zip(("x0", "y0", "x1", "y1"), box, strict=True)) | {"area": int((grey < INK).sum())}] if box else []

    return raster.over_rasters(_rasters(spark, sf_dir), "vec_id", run, "x0 int, y0 int, x1 int, y1 int, area long")


@query(f"WITH {PLACES} SELECT vec_id, min(x) AS first, max(x) + 1 AS stop FROM (SELECT vec_id, x, x - row_number() OVER (PARTITION BY vec_id ORDER BY x) AS k FROM (SELECT DISTINCT vec_id, x FROM p WHERE y < 2)) GROUP BY vec_id, k")
def raster_runs(spark, sf_dir):
    """Runs of columns with ink in the upper two rows."""
    return raster.over_rasters(_rasters(spark, sf_dir), "vec_id", lambda grey: [{"first": a, "stop": z} for a, z in raster.runs((grey[:2] < INK).any(axis=0))], "first int, stop int")


@query(
    f"""WITH {PLACES}, r AS (SELECT vec_id, r AS y, count(x) AS n FROM (SELECT DISTINCT vec_id FROM p) CROSS JOIN (SELECT unnest(range(0, 8)) AS r) LEFT JOIN p USING (vec_id) WHERE y = r OR y IS NULL GROUP BY ALL),
c AS (SELECT vec_id, y, sum(n) OVER (PARTITION BY vec_id ORDER BY y) AS upto, sum(n) OVER (PARTITION BY vec_id) AS total FROM r)
SELECT vec_id, CAST(min(y) FILTER (WHERE upto >= CAST(0.2 AS DOUBLE) * total) AS INTEGER) AS top, CAST(min(y) FILTER (WHERE upto >= CAST(0.7 AS DOUBLE) * total) + 1 AS INTEGER) AS bottom FROM c GROUP BY vec_id"""
)
def raster_trim(spark, sf_dir):
    """The rows that hold the ink between a fifth and seven tenths of it."""

    def run(grey: np.ndarray) -> list[dict]:
        ink = grey < INK
        return [dict(zip(("top", "bottom"), raster.trimmed(ink.sum(axis=1), 0.2, 0.7), strict=True))] if ink.any() else []

    return raster.over_rasters(_rasters(spark, sf_dir), "vec_id", run, "top int, bottom int")


@query(
    f"""WITH {PLACES}, c AS (SELECT vec_id, x FROM p GROUP BY vec_id, x HAVING count(*) >= 3), s AS (SELECT vec_id, x, x - lag(x) OVER (PARTITION BY vec_id ORDER BY x) AS gap FROM c)
SELECT vec_id, CAST(gap AS INTEGER) AS gap, x AS start FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY gap DESC, x DESC) AS r FROM s WHERE gap IS NOT NULL) WHERE r = 1"""
)
def raster_gap(spark, sf_dir):
    """The widest step between columns with three inked places."""

    def run(grey: np.ndarray) -> list[dict]:
        found = raster.after_widest_gap(grey, INK, 3)
        return [{"gap": found[0], "start": found[1]}] if found else []

    return raster.over_rasters(_rasters(spark, sf_dir), "vec_id", run, "gap int, start int")


GREY = "g AS (SELECT vec_id, CAST(i % 8 AS INTEGER) AS x, CAST(i // 8 AS INTEGER) AS y, CAST(least(255, greatest(0, floor(128 + 64 * CAST(embedding[i + 1] AS DOUBLE)))) AS BIGINT) AS v FROM (SELECT vec_id, embedding, unnest(range(0, 64)) AS i FROM embeddings WHERE len(embedding) = 64))"


@query(f"WITH {GREY} SELECT vec_id, CAST(255 * 24 + sum(v) FILTER (WHERE x < 6) AS BIGINT) AS amount, CAST(sum(v) FILTER (WHERE x = 0) AS BIGINT) AS first_column FROM g GROUP BY vec_id")
def raster_fit(spark, sf_dir):
    """A right page cut to six columns and padded to twelve rows: all of it, and its first column."""

    def run(grey: np.ndarray) -> list[dict]:
        made = raster.fitted(grey, 12, 6, "right").astype(int)
        return [{"amount": int(made.sum()), "first_column": int(made[2:10, 0].sum())}]

    return raster.over_rasters(_rasters(spark, sf_dir), "vec_id", run, "amount long, first_column long")


@query(
    f"""WITH {PLACES},
a AS (SELECT vec_id, x, y FROM p WHERE x < 4), b AS (SELECT vec_id, x - 4 AS x, y FROM p WHERE x >= 4), v AS (SELECT vec_id FROM embeddings WHERE len(embedding) = 64),
ta AS (SELECT DISTINCT vec_id, x + dx AS x, y + dy AS y FROM a, (SELECT unnest([-1, 0, 1]) AS dx), (SELECT unnest([-1, 0, 1]) AS dy)), tb AS (SELECT DISTINCT vec_id, x + dx AS x, y + dy AS y FROM b, (SELECT unnest([-1, 0, 1]) AS dx), (SELECT unnest([-1, 0, 1]) AS dy)),
n AS (SELECT vec_id, count(*) AS n FROM a GROUP BY ALL), m AS (SELECT vec_id, count(*) AS m FROM b GROUP BY ALL),
i AS (SELECT vec_id, count(*) AS i FROM a SEMI JOIN tb USING (vec_id, x, y) GROUP BY ALL), j AS (SELECT vec_id, count(*) AS j FROM b SEMI JOIN ta USING (vec_id, x, y) GROUP BY ALL)
SELECT vec_id, CASE WHEN n IS NULL OR m IS NULL THEN 1 ELSE round((1 - coalesce(i, 0) / n + 1 - coalesce(j, 0) / m) / 2 + 0.25::DOUBLE * abs(n - m) / greatest(n, m), 9) END AS error FROM v LEFT JOIN n USING (vec_id) LEFT JOIN m USING (vec_id) LEFT JOIN i USING (vec_id) LEFT JOIN j USING (vec_id)"""
)
def raster_mask_error(spark, sf_dir):
    """The left half against the right."""
    return raster.over_rasters(_rasters(spark, sf_dir), "vec_id", lambda grey: [{"error": round(raster.mask_error(grey[:, :4] < INK, grey[:, 4:] < INK), 9)}], "error double")
