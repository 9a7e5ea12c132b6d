"""A generalised additive model with pairwise interactions, boosted by shallow trees over bins.

Features are cut into bins at quantiles. Round by round and feature by feature, a tree of at most four leaves
over the feature's bins takes a small step on the logistic loss and is added to the feature's table. The pairs
that explain most of what is left then get tables of their own in the same way. A score is a sum of table entries.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Additive:
    """cuts: per feature; tables: per feature a value per bin; pairs: (i, j, table over coarse bins)."""

    base: float
    cuts: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]]
    coarse: list[np.ndarray]

    def score(self, x: np.ndarray) -> np.ndarray:
        bins = [np.searchsorted(c, x[:, f], side="right") for f, c in enumerate(self.cuts)]
        total = np.full(len(x), self.base)
        for b, t in zip(bins, self.tables, strict=True):
            total += t[b]
        for i, j, t in self.pairs:
            total += t[self.coarse[i][bins[i]], self.coarse[j][bins[j]]]
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def _leaf(g: float, h: float, ridge: float) -> float:
    return g / (h + ridge)


def _cut(g: np.ndarray, h: np.ndarray, n: np.ndarray, ridge: float, least: int) -> tuple[float, int]:
    """The best place to cut the bins in two, and what it gains over one leaf."""
    gl, hl, nl = np.cumsum(g)[:-1], np.cumsum(h)[:-1], np.cumsum(n)[:-1]
    if not len(gl):
        return 0.0, -1
    gr, hr, nr = g.sum() - gl, h.sum() - hl, n.sum() - nl
    gain = np.where((nl >= least) & (nr >= least), gl**2 / (hl + ridge) + gr**2 / (hr + ridge), 0)
    at = int(gain.argmax())
    return float(gain[at] - g.sum() ** 2 / (h.sum() + ridge)), at + 1


def _tree(g: np.ndarray, h: np.ndarray, n: np.ndarray, ridge: float, least: int) -> np.ndarray:
    """A value per bin: at most two levels of cuts."""
    bounds = [0, len(g)]
    for _ in range(2):
        for a, z in list(zip(bounds, bounds[1:], strict=False)):
            gain, at = _cut(g[a:z], h[a:z], n[a:z], ridge, least)
            if gain > 1e-9:
                bounds.append(a + at)
        bounds.sort()
    out = np.zeros(len(g))
    for a, z in zip(bounds, bounds[1:], strict=False):
        out[a:z] = _leaf(g[a:z].sum(), h[a:z].sum(), ridge)
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray, n: np.ndarray, ridge: float, least: int) -> np.ndarray:
    """Over a grid: one cut of the rows, then one of the columns in each half; or the other way round."""
    best = (-1.0, np.zeros_like(g))
    for turn in (False, True):
        a, b, c = (x.T if turn else x for x in (g, h, n))
        _, at = _cut(a.sum(1), b.sum(1), c.sum(1), ridge, least)
        out, worth = np.zeros_like(a), 0.0
        for part in (slice(0, at), slice(at, len(a))) if at > 0 else (slice(0, len(a)),):
            ga, ha, na = a[part].sum(0), b[part].sum(0), c[part].sum(0)
            gain, col = _cut(ga, ha, na, ridge, least)
            for cols in (slice(0, col), slice(col, len(ga))) if gain > 1e-9 else (slice(0, len(ga)),):
                out[part, cols] = _leaf(ga[cols].sum(), ha[cols].sum(), ridge)
                worth += ga[cols].sum() ** 2 / (ha[cols].sum() + ridge)
        if worth > best[0]:
            best = (worth, out.T if turn else out)
    return best[1]


def fit(x: np.ndarray, y: np.ndarray, bins: int = 32, rounds: int = 150, rate: float = 0.1, pairs: int = 6, grid: int = 8, ridge: float = 1.0, least: int = 5) -> Additive:
    """x: rows by features, finite; y: 0 or 1. Without rows, or of one class alone, the score is constant."""
    rows, features = x.shape
    share = (y.sum() + 0.5) / (rows + 1)
    base = float(np.log(share / (1 - share)))
    cuts = [np.unique(np.quantile(x[:, f], np.arange(1, bins) / bins)) if rows else np.zeros(0) for f in range(features)]
    tables = [np.zeros(len(c) + 1) for c in cuts]
    coarse = [np.arange(len(c) + 1) * grid // (len(c) + 1) for c in cuts]
    model = Additive(base, cuts, tables, [], coarse)
    if not rows or y.min() == y.max():
        return model
    own = [np.searchsorted(c, x[:, f], side="right") for f, c in enumerate(cuts)]
    counts = [np.bincount(b, minlength=len(t)) for b, t in zip(own, tables, strict=True)]
    total = np.full(rows, base)
    for _ in range(rounds):
        for f, b in enumerate(own):
            p = 1 / (1 + np.exp(-total))
            g = np.bincount(b, y - p, len(tables[f]))
            h = np.bincount(b, p * (1 - p), len(tables[f]))
            step = rate * _tree(g, h, counts[f], ridge, least)
            tables[f] += step
            total += step[b]
    cells = lambda i, j: coarse[i][own[i]] * grid + coarse[j][own[j]]
    p = 1 / (1 + np.exp(-total))
    worth = []
    for i in range(features):
        for j in range(i):
            c = cells(i, j)
            g, h = np.bincount(c, y - p, grid * grid), np.bincount(c, p * (1 - p), grid * grid)
            worth.append((float((g**2 / (h + ridge)).sum()), i, j))
    chosen = [(i, j, np.zeros((grid, grid)), cells(i, j)) for _, i, j in sorted(worth, reverse=True)[:pairs]]
    seen = [np.bincount(c, minlength=grid * grid).reshape(grid, grid) for *_, c in chosen]
    for _ in range(rounds):
        for (_, _, table, c), n in zip(chosen, seen, strict=True):
            p = 1 / (1 + np.exp(-total))
            g = np.bincount(c, y - p, grid * grid).reshape(grid, grid)
            h = np.bincount(c, p * (1 - p), grid * grid).reshape(grid, grid)
            step = rate * _pair_tree(g, h, n, ridge, least)
            table += step
            total += step.ravel()[c]
    model.pairs = [(i, j, t) for i, j, t, _ in chosen]
    return model
