"""Embedding near-duplicates by product quantisation.

Unit vectors lie in inverted lists of coarse centroids; what is left of them after the centroid is coded by
subspaces. Two vectors of different lists lie on either side of the plane between the lists' centroids, and their
distances to it add up to at most their own distance. So a vector probes each list whose plane is within half the
reach: of any pair near enough, the one nearer to the plane meets the other, and both are credited by it.
Lists that lie together form a shard, and a vector goes once to each shard in which it probes a list. In a
list, tables of a query's distances to code words give its distance to each coded member; with the
member's own coding error this bounds the true distance exactly, and only pairs that pass are compared.
Centroids are fitted on a bounded sample, their number grows with the square root of the vectors, and every
vector is indexed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, mapped, spanning, stored
from .vectors import batches_of, bounded_sample, finite, kmeans, matrix, meet, packed, squares, unpacked

#: Rows that centroids and code words are fitted on at most; lists at most and in a shard; members and queries that meet at a time.
SAMPLE, LISTS, SHARD, MOST = 65_536, 8192, 64, (8192, 8192)
SUBSPACES, WORDS = 16, 32


@dataclass
class Index:
    """coarse: centroids; shard: of each list; words: per subspace its code words, over columns cuts[s]:cuts[s + 1]."""

    coarse: np.ndarray
    shard: np.ndarray
    words: list[np.ndarray]
    cuts: list[int]

    @staticmethod
    def fit(x: np.ndarray, lists: int, subspaces: int = SUBSPACES, words: int = WORDS) -> Index:
        coarse = kmeans(x, max(1, min(lists, len(x) // 8))) if len(x) else np.zeros((1, x.shape[1]))
        shard = squares(coarse, kmeans(coarse, -(-len(coarse) // SHARD))).argmin(1)
        x = x[:: max(1, len(x) // 8192)]
        rest = x - coarse[squares(x, coarse).argmin(1)]
        cuts = np.linspace(0, x.shape[1], min(subspaces, x.shape[1]) + 1).astype(int).tolist()
        made = [kmeans(rest[:, a:z], words) if len(x) else np.zeros((1, z - a)) for a, z in zip(cuts, cuts[1:], strict=False)]
        return Index(coarse, shard, made, cuts)

    def code(self, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes, and how far each coded vector is from the true one."""
        codes = np.empty((len(rest), len(self.words)), np.uint8)
        error = np.zeros(len(rest))
        for s, w in enumerate(self.words):
            part = rest[:, self.cuts[s] : self.cuts[s + 1]]
            codes[:, s] = squares(part, w).argmin(1)
            error += ((part - w[codes[:, s]]) ** 2).sum(1)
        return codes, np.sqrt(error)

    def probes(self, x: np.ndarray, own: np.ndarray, margin: float) -> np.ndarray:
        """Whether each vector probes each list: its own, and those whose plane is within margin."""
        d = squares(x, self.coarse)
        gap = np.sqrt(squares(self.coarse, self.coarse))[own]
        plane = (d - d[np.arange(len(x)), own][:, None]) / np.maximum(2 * gap, 1e-12)
        return (plane <= margin + 1e-6) | (gap < 1e-9)

    def planes(self, x: np.ndarray, own: np.ndarray, other: np.ndarray) -> np.ndarray:
        """Each vector's distance to the plane between its own list and another; the same wherever it is computed."""
        a, b = self.coarse[own], self.coarse[other]
        gap = np.sqrt(((a - b) ** 2).sum(1))
        return np.where(gap < 1e-9, 0.0, (((x - b) ** 2).sum(1) - ((x - a) ** 2).sum(1)) / np.maximum(2 * gap, 1e-12))

    def distances(self, rest: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Asymmetric: of queries' rests to coded members, from tables."""
        total = np.zeros((len(rest), len(codes)), np.float32)
        for s, w in enumerate(self.words):
            total += squares(rest[:, self.cuts[s] : self.cuts[s + 1]], w).astype(np.float32).take(codes[:, s], axis=1)
        return np.sqrt(total, out=total)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def near_duplicates(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", cosine: float = 0.95) -> DataFrame:
    """key, n_links, component_id, kept: a row per row of rows.

    Vectors link at that cosine (double precision) or more. n_links counts the other rows linked directly, component_id
    is the smallest key reachable by links, kept whether it is the row's own. Vectors that are null, empty, zero or
    hold a null or a component that isn't finite link with nothing and are their own component; so do rows
    whose key is null, which have no component and aren't kept. Shorter vectors are padded with zeros. Equal vectors
    are one node with a number of copies. Repeated rows are vectors of their own. Other columns are not read.
    """
    spark = rows.sparkSession
    x = F.col(vector).cast("array<double>")
    good = F.col(key).isNotNull() & finite(F.col(vector)) & F.coalesce(F.exists(x, lambda v: v != 0), F.lit(False))
    marked = rows.select(F.col(key).alias("key"), F.when(good, x).alias("x"))
    hashed = marked.select("key", "x", F.xxhash64("x").alias("h1"), F.xxhash64(F.lit("second"), "x").alias("h2"))
    classes = hashed.where("x IS NOT NULL").groupBy("h1", "h2").agg(F.min("key").alias("id"), F.count("*").alias("copies"), F.first("x").alias("x"))
    classes = stored(classes, "classes")
    width, n = classes.agg(F.max(F.size("x")), F.count("*")).first()
    if not width:
        return marked.select(F.col("key").alias(key), F.lit(0).cast("long").alias("n_links"), F.col("key").cast("long").alias("component_id"), F.col("key").isNotNull().alias("kept"))
    lists = int(min(2 * np.sqrt(n), LISTS))
    sample = bounded_sample(classes, "id", "x", min(SAMPLE, max(8192, 8 * lists)), width)
    shared = spark.sparkContext.broadcast(Index.fit(unit(sample), lists))
    reach = float(np.sqrt(max(0.0, 2 - 2 * cosine)))
    # Vectors move as they came: in four bytes a component, if they had four.
    kind = np.float32 if rows.schema[vector].dataType.simpleString() == "array<float>" else np.float64

    def place(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        of = np.eye(index.shard.max() + 1, dtype=np.float32)[index.shard]
        for batch in batches_of(it, 2048):
            raw = matrix(batch.column(2), width)
            x = unit(raw)
            home = squares(x, index.coarse).argmin(1)
            codes, error = index.code(x - index.coarse[home])
            to = index.probes(x, home, reach / 2).astype(np.float32) @ of > 0
            own = index.shard[home]
            to[np.arange(len(x)), own] = False
            row, g = np.nonzero(to)
            every = np.concatenate([np.arange(len(x)), row])
            code = pa.array(packed(codes).to_pylist() + [None] * len(row), pa.binary())
            columns = [pa.array(np.concatenate([own, g])), batch.column(0).take(pa.array(every)), batch.column(1).take(pa.array(every)), packed(raw.astype(kind)).take(pa.array(every))]
            columns += [code, pa.array(error[every]), pa.array(home[every])]
            yield pa.RecordBatch.from_arrays(columns, names=["g", "id", "copies", "data", "code", "error", "home"])

    placed = mapped(classes.select(F.col("id").cast("long").alias("id"), "copies", "x"), place, "g long, id long, copies long, data binary, code binary, error double, home long")
    placed = stored(placed, "lists")

    def solve(members: pa.Table, queries: pa.Table) -> pa.Table:
        index = shared.value
        empty = pa.table({"id": pa.array([], pa.int64()), "links": pa.array([], pa.int64()), "root": pa.array([], pa.int64())})
        if not members.num_rows or not queries.num_rows:
            return empty
        y, q = (unit(unpacked(t.column("data"), kind).astype(np.float64)) for t in (members, queries))
        codes, error = unpacked(members.column("code"), np.uint8), members.column("error").to_numpy()
        y_id, y_copies, y_home = (members.column(c).to_numpy() for c in ("id", "copies", "home"))
        q_id, q_copies, q_home = (queries.column(c).to_numpy() for c in ("id", "copies", "home"))
        asks = np.concatenate([index.probes(q[at : at + 1024], q_home[at : at + 1024], reach / 2 + 1e-6) for at in range(0, len(q), 1024)])
        names, node = np.unique(np.concatenate([q_id, y_id]), return_inverse=True)
        root, total = np.arange(len(names)), np.zeros(len(names), np.int64)

        def found(a: np.ndarray, b: np.ndarray) -> None:
            """Counts the pairs and joins their components, so that no list of all pairs is held."""
            nonlocal root
            same = q_home[a] == y_home[b]
            # In one list each meets the other; of different lists, the nearer to the plane counts for both.
            far = index.planes(q[a], q_home[a], y_home[b]) - index.planes(y[b], y_home[b], q_home[a])
            use = same | (far < 0) | (far == 0) & (q_id[a] < y_id[b])
            a, b, same = a[use], b[use], same[use]
            np.add.at(total, node[a], y_copies[b])
            np.add.at(total, node[len(q) + b[~same]], q_copies[a[~same]])
            x, z = root[node[a]], root[node[len(q) + b]]
            if (x != z).any():
                edges = np.unique(np.stack([x, z], axis=1)[x != z], axis=0)
                root = spanning(len(names), edges[:, 0], edges[:, 1])[root]

        for g in np.unique(y_home):
            mine, who = np.flatnonzero(y_home == g), np.flatnonzero(asks[:, g])
            for at in range(0, len(who), 1024):
                part = who[at : at + 1024]
                for k in range(0, len(mine), 1024):
                    own = mine[k : k + 1024]
                    near = index.distances(q[part] - index.coarse[g], codes[own]) <= (error[own] + reach + 1e-4)[None, :]
                    i, j = np.nonzero(near)
                    for n in range(0, len(i), 50_000):
                        a, b = part[i[n : n + 50_000]], own[j[n : n + 50_000]]
                        hit = (np.einsum("ij,ij->i", q[a], y[b]) >= cosine) & (q_id[a] != y_id[b])
                        if hit.any():
                            found(a[hit], b[hit])
        use = (total > 0) | (root != np.arange(len(names)))
        return pa.table({"id": names[use].astype(np.int64), "links": total[use], "root": names[root[use]].astype(np.int64)})

    members = placed.where("code IS NOT NULL").select("g", "id", "copies", "data", "code", "error", "home")
    queries = placed.select("g", "id", "copies", "data", "home")
    found = stored(meet(members, queries, solve, "id long, links long, root long", MOST), "links")
    linked = found.groupBy("id").agg(F.sum("links").alias("links"))
    grouped = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")).distinct())
    whole = classes.select("h1", "h2", "id", "copies").join(linked, "id", "left").join(grouped.withColumnRenamed("node", "id"), "id", "left")
    whole = whole.select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").cast("long").alias("component"))
    apart = hashed.where("x IS NULL").select("key", F.lit(0).cast("long").alias("n_links"), F.col("key").cast("long").alias("component"))
    out = hashed.where("x IS NOT NULL").select("key", "h1", "h2").join(whole, ["h1", "h2"]).select("key", "n_links", "component").union(apart)
    kept = F.coalesce(F.col("key") == F.col("component"), F.lit(False))
    return out.select(F.col("key").alias(key), "n_links", F.col("component").alias("component_id"), kept.alias("kept"))
