"""Claims: values with evidence, or the reason why there is none. Unknown is neither null nor zero nor equal to anything."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The reasons that an unknown claim may give.
REASONS = ("not-observed", "ambiguous", "unsupported", "invalid", "budget-exhausted", "redacted", "below-policy-threshold")


def known(value: Column, confidence: Column, evidence: Column | None = None) -> Column:
    """confidence may be null: unknown confidence."""
    return F.struct(F.lit("known").alias("status"), value.alias("value"), confidence.cast("double").alias("confidence"), (evidence if evidence is not None else F.array().cast("array<string>")).alias("evidence"), F.lit(None).cast("string").alias("reason"))


def unknown(kind: str, reason: str | Column) -> Column:
    why = F.lit(reason) if isinstance(reason, str) else reason
    return F.struct(F.lit("unknown").alias("status"), F.lit(None).cast(kind).alias("value"), F.lit(None).cast("double").alias("confidence"), F.array().cast("array<string>").alias("evidence"), why.alias("reason"))


def gate(status: Column, confidence: Column, reason: Column, least: float | None) -> Column:
    """'ok', 'unknown:<reason>' or 'below-policy'. With a threshold, a known value of unknown confidence fails."""
    passes = F.lit(True) if least is None else F.coalesce(confidence >= least, F.lit(False))
    return F.when(status != "known", F.concat(F.lit("unknown:"), F.coalesce(reason, F.lit("not-observed")))).when(passes, "ok").otherwise("below-policy")


def well_formed(claim: Column) -> Column:
    """A known claim has a value and evidence; an unknown one a listed reason and no value."""
    good = claim["value"].isNotNull() & (F.size(claim["evidence"]) > 0) & (claim["confidence"].isNull() | claim["confidence"].between(0, 1))
    bad = claim["value"].isNull() & claim["reason"].isin(*REASONS)
    return F.when(claim["status"] == "known", good).when(claim["status"] == "unknown", bad).otherwise(False)


def check_policy(tolerances: dict[str, float], confidence: float | None) -> None:
    for name, x in tolerances.items():
        if not (x >= 0 and x < float("inf")):
            raise ValueError(f"{name} must be finite and not negative")
    if confidence is not None and not 0 <= confidence <= 1:
        raise ValueError("a confidence lies between 0 and 1")
