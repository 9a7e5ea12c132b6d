"""What a comparison covers, and what it says where it can't compare."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .pages import built_lines


def scalars(glyphs: DataFrame, page: str, order: str, text: str, mapped: Column) -> DataFrame:
    """page, text: what all glyphs of a page say, in order; null if one isn't mapped."""
    return built_lines(glyphs.withColumn("__text", F.when(mapped, F.col(text))), [page], order, "__text")


def unmapped(glyphs: DataFrame, text: str, mapped: Column) -> DataFrame:
    return glyphs.where(~F.coalesce(mapped, F.lit(False)) | F.col(text).isNull())


def word_references(lines: DataFrame, line: list[str], words: str) -> DataFrame:
    """line, start, stop of every word. words: an array of structs start, stop; a line without has none."""
    return lines.select(*line, F.explode(words).alias("__w")).select(*line, "__w.start", "__w.stop")


def lines_without_text(lines: DataFrame, line: list[str], text: str) -> DataFrame:
    """line, code of candidate lines whose text is unknown."""
    return lines.where(F.col(text).isNull()).select(*line, F.lit("candidate-unmapped-glyph").alias("code"))


def invalid_field(horizontal: float, baseline: float, text_confidence: float | None, geometry_confidence: float | None) -> str | None:
    """The first field of a policy that isn't valid: tolerances are finite and not negative, confidences None or between 0 and 1."""
    for name, x in (("horizontal_tolerance_pt", horizontal), ("baseline_tolerance_pt", baseline)):
        if not 0 <= x < float("inf"):
            return name
    for name, y in (("text_confidence", text_confidence), ("geometry_confidence", geometry_confidence)):
        if y is not None and not 0 <= y <= 1:
            return name
    return None


def invalid_policy(scans: DataFrame, candidates: DataFrame, page: str, field: str) -> DataFrame:
    """page, statuses, coverage and diagnostic of a comparison under such a policy: nothing matches and all is unknown."""
    sizes = lambda df, name: df.groupBy(page).agg(F.count("*").alias(name))
    both = sizes(scans, "total_scan").join(sizes(candidates, "total_candidate"), page, "full")
    return both.select(
        page,
        *[F.lit("unknown").alias(f"{x}_status") for x in ("content", "geometry", "overall")],
        F.lit(0).cast("long").alias("matched_scan"),
        F.coalesce("total_scan", F.lit(0)).cast("long").alias("total_scan"),
        F.lit(0).cast("long").alias("matched_candidate"),
        F.coalesce("total_candidate", F.lit(0)).cast("long").alias("total_candidate"),
        F.lit("invalid-policy").alias("code"),
        F.lit(field).alias("field"),
    )


def _reason(failure: Column) -> Column:
    return F.when(failure.startswith("unknown:"), F.substring_index(failure, ":", -1))


def text_diagnostic(failure: Column) -> Column:
    """code, reason for what a text claim's gate says (see claims.gate); null for ok."""
    code = F.when(failure.startswith("unknown:"), "text-claim-unknown").when(failure == "below-policy", "text-confidence-below-policy")
    return F.when(code.isNotNull(), F.struct(code.alias("code"), _reason(failure).alias("reason")))


def geometry_diagnostic(failure: Column) -> Column:
    code = F.when(failure.startswith("unknown:"), "geometry-claim-unknown").when(failure == "below-policy", "geometry-confidence-below-policy")
    return F.when(code.isNotNull(), F.struct(code.alias("code"), _reason(failure).alias("reason")))


def parent_diagnostic(failure: Column) -> Column:
    """code, reason for a word whose parent line has no partner (failure as match.parent_lines gives it, or null where there is no parent)."""
    code = F.when(failure.startswith("unknown:"), "text-claim-unknown").when(failure == "below-policy", "text-confidence-below-policy")
    code = code.when(failure.isin("ambiguous", "collision"), "ambiguous-text-match").otherwise("unmatched-text")
    return F.struct(code.alias("code"), _reason(failure).alias("reason"))
