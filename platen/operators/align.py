"""Sequence alignment, one pair of sequences held at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import nan

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .grouping import dealt


#: Cells of a table that are held at a time, besides one row for each block of rows.
CELLS = 8_000_000
#: Rows of an Arrow batch, about.
ROWS = 20_000


def _blocks(n: int, m: int, cost: int) -> int:
    """Rows of a block: those of a block and one kept for each block, of cost cells a place, take least together."""
    return max(1, min(n, int((cost * n) ** 0.5) + 1, CELLS // (m + 1) + 1))


def lcs(a: list, b: list) -> list[tuple[int, int]]:
    """Pairs of a longest common subsequence: matches are taken as they come, and of equal ways the left side goes on.

    The table of lengths is never held whole: a row is kept for each block of rows, in one bit a place, and a block's rows are
    made again when the way comes through it. What has no equal on the right is passed over first, which no way notices.
    """
    own = set(b)
    places = [i for i, x in enumerate(a) if x in own]
    codes = {x: n for n, x in enumerate(dict.fromkeys(b))}
    left = [codes[a[i]] for i in places]
    right = np.array([codes[x] for x in b], np.int64)
    n, m = len(left), len(b)
    size = _blocks(n, m, 1)

    def above(i: int, row: np.ndarray) -> np.ndarray:
        # A match is never worse than a step on either side, so the row is a running maximum from its end.
        best = np.where(right == left[i], row[1:] + 1, row[:-1])
        return np.append(np.maximum.accumulate(best[::-1])[::-1], 0).astype(np.int32)

    kept: dict[int, np.ndarray] = {}
    row = np.zeros(m + 1, np.int32)
    for i in range(n - 1, -1, -1):
        if (i + 1) % size == 0:
            kept[i + 1] = np.packbits((row[:-1] - row[1:]).astype(bool))
        row = above(i, row)
    out, i, j = [], 0, 0
    held: list[np.ndarray] = []
    first = last = 0
    while i < n and j < m:
        if not held or i >= last:
            first, last = i - i % size, min(n, i - i % size + size)
            steps = np.unpackbits(kept[last], count=m) if last in kept else np.zeros(m, np.uint8)
            held = [np.append(np.cumsum(steps[::-1], dtype=np.int32)[::-1], np.int32(0))]
            for k in range(last - 1, first - 1, -1):
                held.append(above(k, held[-1]))
            held.reverse()
        if left[i] == right[j]:
            out.append((places[i], j))
            i, j = i + 1, j + 1
        elif held[i + 1 - first][j] >= held[i - first][j + 1]:
            i += 1
        else:
            j += 1
    return out


def cost_alignment(a: list[float], b: list[float], skip: float = 0.35, cap: float = 0.7, slope: float = 3.0, vertical: list[list[float]] | None = None) -> list[tuple[int | None, int | None]]:
    """The cheapest way through both: a pair costs its capped difference, a skip its price; of equal ways (to 1e-12) the pair, then a skip on the left.

    A row of costs is kept for each block of rows; a block's moves are made again when the way comes through it.
    """
    n, m = len(a), len(b)
    right, steps = np.array(b, float), np.arange(m + 1) * skip
    size = _blocks(n, m, 8)

    def below(i: int, cost: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        pair = np.full(m + 1, np.inf)
        pair[1:] = cost[:-1] + np.minimum(cap, slope * np.abs(a[i - 1] - right) + (np.array(vertical[i - 1]) if vertical else 0.0))
        up = cost + skip
        # Skips on the right add up along the row.
        best = np.minimum.accumulate(np.minimum(pair, up) - steps) + steps
        return best, np.where(pair <= best + 1e-12, 1, np.where(up <= best + 1e-12, 2, 3)).astype(np.int8)

    kept, cost = {0: steps.copy()}, steps.copy()
    for i in range(1, n + 1):
        cost, _ = below(i, cost)
        if i % size == 0:
            kept[i] = cost
    out: list[tuple[int | None, int | None]] = []
    i, j, first = n, m, n + 1
    moves: list[np.ndarray] = []
    while i or j:
        if i and i <= first:
            first = (i - 1) // size * size
            cost, moves = kept[first], []
            for k in range(first + 1, i + 1):
                cost, move = below(k, cost)
                moves.append(move)
        k = moves[i - first - 1][j] if i else 3
        if k == 1:
            i, j = i - 1, j - 1
            out.append((i, j))
        elif k == 2:
            i -= 1
            out.append((i, None))
        else:
            j -= 1
            out.append((None, j))
    return out[::-1]


def _aligned(left: DataFrame, right: DataFrame, group: str, order: str, value: str, ways: Callable[[list, list], list[tuple[int | None, int | None]]]) -> DataFrame:
    """group, left_order, right_order of each step. Both sides' rows go sorted through a partition in Arrow batches; one group is held."""
    kinds = dict(left.dtypes)
    side = lambda df, n: df.select(F.col(group).cast(kinds[group]).alias(group), F.lit(n).alias("__side"), F.col(order).cast(kinds[order]).alias(order), value)
    rows = dealt(side(left, 0).union(side(right, 1)), group)
    first = F.row_number().over(Window.partitionBy(group).orderBy("__side", F.col(order).asc_nulls_last())) == 1
    out_types = to_arrow_schema(left.select(group, F.col(order).alias("left_order"), F.col(order).alias("right_order")).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: tuple[list, list, list] = ([], [], [])
        key, orders, values = None, ([], []), ([], [])

        def close() -> None:
            for i, j in ways(*values):
                out[0].append(key)
                out[1].append(None if i is None else orders[0][i])
                out[2].append(None if j is None else orders[1][j])

        def made() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, out_types, strict=True)], names=out_types.names)
            for x in out:
                x.clear()
            return batch

        for batch in batches:
            for new, own, n, place, x in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if new:
                    close()
                    key, orders, values = own, ([], []), ([], [])
                    if len(out[0]) >= ROWS:
                        yield made()
                orders[n].append(place)
                values[n].append(x)
        close()
        yield made()

    return rows.select(first.alias("__first"), group, "__side", order, value).mapInArrow(run, f"`{group}` {kinds[group]}, left_order {kinds[order]}, right_order {kinds[order]}")


def lcs_pairs(left: DataFrame, right: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """group, left_order, right_order of each pair."""
    return _aligned(left, right, group, order, value, lcs)


def line_alignment(left: DataFrame, right: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """group, left_order, right_order: null on the side that a step skips."""
    number = lambda df: df.select(group, F.col(order).cast("long").alias(order), F.coalesce(F.col(value).cast("double"), F.lit(nan)).alias(value))
    return _aligned(number(left), number(right), group, order, value, cost_alignment)
