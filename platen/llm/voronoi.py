"""Exact top-k by inner product, as a Voronoi join.

Data and queries are grouped by their nearest pivot. A group's summary is its radius about the pivot and its
largest norm. Each query is first solved in its own group, which gives a floor for its k-th score; it is then
sent to just those other groups whose summary allows a score of at least that floor, and these are solved
locally. The queries are what is replicated, for they are the smaller side; data move once. Bounds are exact:
the result is that of comparing all.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import mapped, stored
from .vectors import batches_of, bounded_sample, finite, kmeans, matrix, meet, packed, squares, unpacked

SAMPLE, PIVOTS = 8192, 64


def _floor(v: Column) -> Column:
    """Spark's floor gives a long; beyond 2**53 a double is whole as it is."""
    return F.when(F.abs(v) < 2.0**53, F.floor(v).cast("double")).otherwise(v)


def whole_numbers(vector: Column, scale: float = 256.0) -> Column:
    """floor(scale * component) of each component, as doubles; null for a vector that isn't valid, for floor would make NaN and infinity finite."""
    return F.when(finite(vector), F.transform(vector.cast("array<double>"), lambda v: _floor(v * scale)))


def _whole(q: np.ndarray, q_id: np.ndarray, y: np.ndarray, y_id: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(id, other, score) of each query's k best in whole numbers of any size; a score beyond 64 bits is an error."""
    out = []
    y_rows = [list(map(int, row)) for row in y.tolist()]
    for row, own in zip(q.tolist(), q_id.tolist(), strict=True):
        row = list(map(int, row))
        scores = [(-sum(map(operator.mul, row, other)), n) for other, n in zip(y_rows, y_id.tolist(), strict=True) if n != own]
        for score, n in sorted(scores)[:k]:
            if not -(2**63) <= -score < 2**63:
                raise OverflowError(f"the product of {own} and {n} has more than 64 bits")
            out.append((own, n, -score))
    return out


def top_k(rows: DataFrame, queries: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding", pivots: int = PIVOTS) -> DataFrame:
    """query_id, rank, vec_id, score: for each row where queries holds, its k highest inner products among all other rows.

    vector holds whole numbers. Products are exact: in floating point while norms keep them under 2**53, else in whole numbers
    of any size; a score among the k that has more than 64 bits is an error. Ties go to the smaller key, then rank by
    rank; where there are fewer rows, all are returned. Rows whose key is null, or whose vector is null, empty or holds a null or a
    component that isn't finite, take no part. A row is no candidate for queries of its own key. Shorter vectors are
    padded with zeros. Repeated rows are candidates once each, and one query.
    """
    good = F.col(key).isNotNull() & finite(F.col(vector))
    valid = rows.where(good).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("x"), F.coalesce(queries, F.lit(False)).alias("asks"))
    schema = "id long, other long, score long"
    width = valid.agg(F.max(F.size("x"))).first()[0]
    if not width:
        none = valid.select(F.col("id").alias("query_id"), F.lit(0).alias("rank"), F.col("id").alias("vec_id"), F.lit(0).cast("long").alias("score"))
        return none.where("false")
    centres = kmeans(bounded_sample(valid, "id", "x", SAMPLE, width), pivots)
    shared = rows.sparkSession.sparkContext.broadcast(centres)

    def place(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(it, 2048):
            x = matrix(batch.column(1), width)
            d = squares(x, shared.value)
            own = d.argmin(1)
            far = np.sqrt(((x - shared.value[own]) ** 2).sum(1))
            columns = [pa.array(own), batch.column(0), packed(x), pa.array(far), pa.array(np.sqrt((x * x).sum(1))), batch.column(2)]
            yield pa.RecordBatch.from_arrays(columns, names=["g", "id", "data", "far", "norm", "asks"])

    placed = stored(mapped(valid, place, "g long, id long, data binary, far double, norm double, asks boolean"), "placed")
    summary = {r.g: (r.far, r.norm) for r in placed.groupBy("g").agg(F.max("far").alias("far"), F.max("norm").alias("norm")).collect()}
    groups = np.array(sorted(summary))
    far, norm = (np.array([summary[g][n] for g in groups]) for n in (0, 1))
    bounds = rows.sparkSession.sparkContext.broadcast((groups, far, norm))

    def solve(members: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] * 3]
        if members.num_rows and asked.num_rows:
            y, q = unpacked(members.column("data")), unpacked(asked.column("data"))
            y_id, q_id = members.column("id").to_numpy(), asked.column("id").to_numpy()
            order = np.argsort(y_id, kind="stable")
            y, y_id = y[order], y_id[order]
            for at in range(0, len(q), 512):
                part, ids = q[at : at + 512], q_id[at : at + 512]
                if np.sqrt((part * part).sum(1).max() * (y * y).sum(1).max()) >= 2.0**53:
                    found = _whole(part, ids, y, y_id, k)
                    out.append([np.array(x, np.int64) for x in zip(*found, strict=True)] if found else out[0])
                    continue
                scores = part @ y.T
                scores[ids[:, None] == y_id[None, :]] = -np.inf
                best = np.argsort(-scores, axis=1, kind="stable")[:, :k]
                value = np.take_along_axis(scores, best, axis=1)
                use = np.isfinite(value)
                out.append([np.broadcast_to(ids[:, None], best.shape)[use], y_id[best][use], value[use].astype(np.int64)])
        made = [np.concatenate(x).astype(np.int64) for x in zip(*out, strict=True)]
        return pa.table(dict(zip(("id", "other", "score"), made, strict=True)))

    asked = placed.where("asks").dropDuplicates(["id"]).select("g", "id", "data")
    members = placed.select("g", "id", "data")
    local = stored(meet(members, asked, solve, schema), "local")
    order = Window.partitionBy("id").orderBy(F.desc("score"), "other")
    floor = local.withColumn("n", F.row_number().over(order)).where(F.col("n") == k).select("id", F.col("score").alias("floor"))

    def send(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, far, norm = bounds.value
        for batch in batches_of(it, 2048):
            q = unpacked(batch.column(2))
            length = np.sqrt((q * q).sum(1))[:, None]
            most = np.minimum(q @ shared.value[groups].T + length * far[None, :], length * norm[None, :])
            most = np.nan_to_num(most, nan=np.inf, posinf=np.inf, neginf=-np.inf)  # beyond what doubles hold
            least = np.nan_to_num(batch.column(3).to_numpy(zero_copy_only=False).astype(float), nan=-np.inf)[:, None]
            slack = 1e-6 * (1 + np.abs(most))
            go = (most + slack >= least) & (groups[None, :] != batch.column(0).to_numpy()[:, None])
            row, to = np.nonzero(go)
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays([pa.array(groups[to]), batch.column(1).take(at), batch.column(2).take(at)], names=["g", "id", "data"])

    sent = asked.join(floor, "id", "left").select("g", "id", "data", "floor")
    sent = mapped(sent, send, "g long, id long, data binary")
    every = local.union(meet(members, sent, solve, schema))
    ranked = every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select(F.col("id").alias("query_id"), "rank", F.col("other").alias("vec_id"), "score")
