"""Three-valued verdicts: violated over unknown over preserved; nothing measured is unknown."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PRESERVED, VIOLATED, UNKNOWN = "preserved", "violated", "unknown"


def combine(*statuses: Column) -> Column:
    """Of statuses in one row."""
    every = F.array(*statuses)
    return (
        F.when(F.array_contains(every, VIOLATED), VIOLATED)
        .when((F.size(every) == 0) | F.exists(every, lambda s: s.isNull() | (s == UNKNOWN)), UNKNOWN)
        .otherwise(PRESERVED)
    )


def rolled_up(status: Column) -> Column:
    """Of a group's rows. No rows give unknown: an aggregate over nothing counts none."""
    return (
        F.when(F.count_if(status == VIOLATED) > 0, VIOLATED)
        .when((F.count(F.lit(1)) == 0) | (F.count_if(status.isNull() | (status == UNKNOWN)) > 0), UNKNOWN)
        .otherwise(PRESERVED)
    )


def from_delta(delta: Column, tolerance: Column) -> Column:
    """Unknown where there is no delta or tolerance; the tolerance itself is preserved."""
    return F.when(delta.isNull() | tolerance.isNull() | F.isnan(delta), UNKNOWN).when(F.abs(delta) <= tolerance, PRESERVED).otherwise(VIOLATED)


def horizontal(start: Column, end: Column, width: Column, tolerance: Column) -> Column:
    return combine(from_delta(start, tolerance), from_delta(end, tolerance), from_delta(width, tolerance))


def content(matched: Column, left: Column, right: Column, reflows: Column) -> Column:
    """Reflow violates; full coverage of both non-empty sides preserves; what merely didn't match stays unknown."""
    whole = (matched > 0) & (matched == left) & (matched == right)
    return F.when(reflows > 0, VIOLATED).when(whole, PRESERVED).otherwise(UNKNOWN)


def geometry(mapped: Column, content_status: Column, matches: Column) -> Column:
    """A violated match violates even where content is unknown."""
    return F.when(matches == VIOLATED, VIOLATED).when(~mapped | (content_status != PRESERVED) | (matches != PRESERVED), UNKNOWN).otherwise(PRESERVED)


def first_reason(*reasons: tuple[Column, str]) -> Column:
    """The first whose condition holds; null where none does."""
    out = F.lit(None).cast("string")
    for condition, name in reversed(reasons):
        out = F.when(condition, name).otherwise(out)
    return out


def consensus(present: Column, supporters: Column, has_geometry: Column) -> Column:
    """Of witnesses that are present and those that support a region."""
    return (
        F.when(has_geometry & (supporters >= 2), "confirmed")
        .when((present >= 2) & (supporters == 0), "disputed")
        .when(has_geometry, "geometry-confirmed")
        .when(supporters >= 2, "text-confirmed")
        .otherwise("unknown")
    )


def line_status(candidates: Column) -> Column:
    return F.when(candidates == 1, PRESERVED).when(candidates > 1, VIOLATED).otherwise(UNKNOWN)


def ineligible(total: Column, content_status: Column, matched: Column, candidates: Column, matched_candidates: Column, lost: Column, key: Column) -> Column:
    """Why a trial can't be chosen; null if it can. lost: unmatched units of both sides; key: its residuals, null without horizontal evidence."""
    return first_reason(
        (total == 0, "empty-scan-scope"),
        (content_status != PRESERVED, "content-not-preserved"),
        ((matched != total) | (matched_candidates != candidates), "partial-coverage"),
        (lost > 0, "unmatched-units"),
        (key.isNull(), "missing-horizontal-evidence"),
    )
