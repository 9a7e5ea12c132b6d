"""What the two vector operators share: valid vectors, pivots, and groups of members that meet queries."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F



def finite(vector: Column) -> Column:
    """Neither null nor empty, no component null or not finite."""
    x = vector.cast("array<double>")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.coalesce((F.size(x) > 0) & ~bad, F.lit(False))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists of doubles as rows; shorter ones are padded with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = np.diff(column.offsets.to_numpy())
    if len(sizes) and (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width))
    out[np.arange(width)[None, :] < sizes[:, None]] = flat
    return out


def unpacked(column: pa.Array | pa.ChunkedArray, kind: type = np.float64) -> np.ndarray:
    """Binary rows of equal length as a matrix."""
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), kind).reshape(len(rows), -1)


def packed(x: np.ndarray) -> pa.Array:
    return pa.array([row.tobytes() for row in np.ascontiguousarray(x)], pa.binary())


def squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of all rows."""
    return np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * (x @ y.T), 0)


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Centroids of at most k groups; equal rows count once among the first ones."""
    start = np.unique(x, axis=0)
    start = start[np.random.default_rng(seed).permutation(len(start))[:k]]
    for _ in range(rounds):
        own = squares(x, start).argmin(1)
        n = np.bincount(own, minlength=len(start))
        sums = np.zeros_like(start)
        np.add.at(sums, own, x)
        start = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], start)
    return start


def bounded_sample(rows: DataFrame, key: str, value: str, n: int, width: int) -> np.ndarray:
    """At most n of the vectors, those of the smallest hashed keys."""
    found = rows.select(key, value).orderBy(F.xxhash64(key), key).limit(n).select(value).toArrow()
    return matrix(found.column(0), width) if found.num_rows else np.zeros((0, width))


def meet(members: DataFrame, queries: DataFrame, solve: Callable[[pa.Table, pa.Table], pa.Table], schema: str, most: tuple[int, int] = (512, 2048)) -> DataFrame:
    """solve(members, queries) over groups of both that share g: every member of a g meets every query of it once.

    Members and queries are cut into chunks of about that many by hash, so a g of any size has groups of bounded size.
    members and queries have columns g and id besides their own.
    """
    sizes = members.groupBy("g").agg(F.count("*").alias("m")).join(queries.groupBy("g").agg(F.count("*").alias("q")), "g")
    sizes = sizes.select("g", F.ceil(F.col("m") / most[0]).cast("int").alias("ms"), F.ceil(F.col("q") / most[1]).cast("int").alias("qs"))
    deal = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = members.join(sizes, "g").withColumn("mc", deal("ms")).withColumn("qc", every("qs")).drop("ms", "qs").withColumn("asks", F.lit(False))
    asked = queries.join(sizes, "g").withColumn("qc", deal("qs")).withColumn("mc", every("ms")).drop("ms", "qs").withColumn("asks", F.lit(True))

    def run(rows: pa.Table) -> pa.Table:
        asks = rows.column("asks").to_numpy()
        return solve(rows.filter(pa.array(~asks)), rows.filter(pa.array(asks)))

    return own.unionByName(asked, allowMissingColumns=True).groupBy("g", "mc", "qc").applyInArrow(run, schema)


def batches_of(it: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    for batch in it:
        for at in range(0, batch.num_rows, n):
            yield batch.slice(at, n)
