"""Parameter search: grids, and loops that the driver runs over jobs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

MOST = 32


def axis(values: list[float], low: float, high: float) -> list[float]:
    """Sorted, without a negative zero; an error for duplicates and values outside."""
    found = sorted(x + 0.0 for x in values)
    if any(not low <= x <= high for x in found) or len(set(found)) < len(found) or not found:
        raise ValueError(f"an axis holds distinct values from {low} to {high}")
    return found


def grid(spark: SparkSession, sizes: list[float], trackings: list[float]) -> DataFrame:
    """trial, size, tracking: sizes first, then trackings; at most 32 trials."""
    cells = [(s, t) for s in axis(sizes, 4, 96) for t in axis(trackings, -2, 2)]
    if len(cells) > MOST:
        raise ValueError(f"a grid has at most {MOST} trials")
    return spark.createDataFrame([(n, float(s), float(t)) for n, (s, t) in enumerate(cells)], "trial int, size double, tracking double")


def feedback(start: float, measure: Callable[[float], tuple[float, float] | None], cycles: int, close: float = 1e-9) -> tuple[float, str]:
    """measure(x) gives an objective and an adjustment. The best x seen, and why it ended: converged, zero-adjustment,
    stagnation (twice no gain), not-comparable or cycles."""
    x, best, best_at, idle = start, float("inf"), start, 0
    for _ in range(cycles):
        found = measure(x)
        if found is None:
            return best_at, "not-comparable"
        objective, change = found
        if objective < best:
            best, best_at, idle = objective, x, 0
        else:
            idle += 1
        if objective <= close:
            return best_at, "converged"
        if change == 0:
            return best_at, "zero-adjustment"
        if idle >= 2:
            return best_at, "stagnation"
        x += change
    return best_at, "cycles"


def coordinate_descent(start: dict[str, float], steps: dict[str, float], error: Callable[[list[dict[str, float]]], list[float]], rounds: int = 20, shrink: float = 0.6) -> dict[str, float]:
    """error takes a grid of settings, one job each time. A step down or up for each parameter; steps shrink; it ends without gain."""
    best, least, steps = dict(start), error([start])[0], dict(steps)
    for _ in range(rounds):
        tried = [best | {k: best[k] + sign * s} for k, s in steps.items() for sign in (-1, 1)]
        errors = error(tried)
        low = min(range(len(tried)), key=errors.__getitem__)
        if errors[low] < least:
            best, least = tried[low], errors[low]
        elif max(steps.values()) < 1e-6:
            break
        steps = {k: s * shrink for k, s in steps.items()}
    return best
