"""Assembly of pages: lines out of glyphs, tokens, page files, formats, regions."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .grouping import dealt

def by_index(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """The i-th cluster of one side meets the i-th of the other; a surplus stays alone."""
    return left.join(right, keys, "full")


def built_lines(glyphs: DataFrame, line: list[str], order: str, text: str) -> DataFrame:
    """line, text: glyphs in order; one glyph without text makes the whole line unknown (null). A line has as many glyphs as it has signs."""
    made = glyphs.groupBy(*line).agg(F.bool_and(F.col(text).isNotNull()).alias("mapped"), F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t")))).alias("g"))
    return made.select(*line, F.when(F.col("mapped"), F.array_join(F.transform("g", lambda x: x["t"]), "")).alias("text"))


def derived_lines(texts: DataFrame, key: str, text: str) -> DataFrame:
    """key, line_no, line, start, break_kind (crlf, lf, cr, none): lines with their span and how they end."""
    parts = texts.select(key, F.posexplode(F.regexp_extract_all(text, F.lit(r"[^\r\n]*(?:\r\n|\n|\r)|[^\r\n]+$"), 0)).alias("line_no", "part"))
    start = F.coalesce(F.sum(F.length("part")).over(Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    part = F.col("part")
    kind = F.when(part.endswith("\r\n"), "crlf").when(part.endswith("\n"), "lf").when(part.endswith("\r"), "cr").otherwise("none")
    return parts.select(key, "line_no", F.regexp_replace(part, r"[\r\n]+$", "").alias("line"), start.alias("start"), kind.alias("break_kind"))


def tokens(lines: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, token_no, token, kind (space, word, sign), start: runs of white space, of letters and digits, and single signs."""
    parts = lines.select(*keys, F.posexplode(F.regexp_extract_all(text, F.lit(r"(?U)\s+|[\p{L}\p{M}\p{N}_]+|[^\s\p{L}\p{M}\p{N}_]"), 0)).alias("token_no", "token"))
    start = F.coalesce(F.sum(F.length("token")).over(Window.partitionBy(*keys).orderBy("token_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    kind = F.when(F.col("token").rlike(r"(?U)^\s"), "space").when(F.col("token").rlike(r"^[\p{L}\p{M}\p{N}_]"), "word").otherwise("sign")
    return parts.select(*keys, "token_no", "token", kind.alias("kind"), start.alias("start"))


def page_files(left: DataFrame, right: DataFrame, path: str = "path") -> DataFrame:
    """page, left_path, right_path, state (ready, left-only, right-only): two listings by the number in their names."""
    number = F.regexp_extract(path, r"(\d+)\.[a-z]+$", 1)
    side = lambda df, name: df.where(number != "").select(number.cast("long").alias("page"), F.col(path).alias(name))
    both = side(left, "left_path").join(side(right, "right_path"), "page", "full")
    return both.withColumn("state", F.when(F.col("left_path").isNull(), "right-only").when(F.col("right_path").isNull(), "left-only").otherwise("ready"))


def once(diagnostics: DataFrame, group: list[str], code: str, order: str) -> DataFrame:
    """Each code of a group once, where it first occurs."""
    return diagnostics.groupBy(*group, code).agg(F.min(order).alias("first"))


def diagonal_runs(pairs: DataFrame, group: list[str], left: str, right: str) -> DataFrame:
    """group, left_first, right_first, length of runs in which both sides go on by one."""
    w = Window.partitionBy(*group, F.col(left) - F.col(right)).orderBy(left)
    rows = pairs.withColumn("__d", F.col(left) - F.col(right)).withColumn("__k", F.col(left) - F.row_number().over(w))
    return rows.groupBy(*group, "__d", "__k").agg(F.min(left).alias("left_first"), F.min(right).alias("right_first"), F.count("*").alias("length")).drop("__d", "__k")


def best_format(pages: DataFrame, formats: DataFrame, page: str, width: Column, height: Column, most: float) -> DataFrame:
    """page, format: the smallest larger error, then sum of errors, then name; null where none is within most, which is less than 1.

    formats (name, w, h) may be any number: a size within most lies in the same cell of a logarithmic grid or in one beside it, so
    pages meet only formats of about their size.
    """
    if not 0 < most < 1:
        raise ValueError("an error lies between 0 and 1")
    step = -math.log(1 - most)
    cell = lambda x: F.floor(F.ln(x) / step)
    near = lambda x: F.explode(F.sequence(F.floor(F.ln(x / (1 + most)) / step - 1e-9), F.floor(F.ln(x / (1 - most)) / step + 1e-9)))
    sized = pages.select(F.col(page).alias("__page"), width.alias("__w"), height.alias("__h")).where("__w > 0 AND __h > 0")
    sized = sized.withColumn("__cw", near(F.col("__w"))).withColumn("__ch", near(F.col("__h")))
    ready = formats.select("name", "w", "h", cell(F.col("w")).alias("__cw"), cell(F.col("h")).alias("__ch"))
    ew, eh = F.abs(F.col("__w") / F.col("w") - 1), F.abs(F.col("__h") / F.col("h") - 1)
    key = F.struct(F.greatest(ew, eh).alias("worst"), (ew + eh).alias("total"), F.col("name").alias("name"))
    pairs = sized.join(ready, ["__cw", "__ch"]).select("__page", key.alias("key")).where(F.col("key.worst") <= most)
    made = pairs.groupBy(F.col("__page").alias(page)).agg(F.min("key")["name"].alias("format"))
    return pages.select(page).join(made, page, "left")


def geometry_independent(child_value: Column, parent_value: Column, child_evidence: Column, parent_evidence: Column) -> Column:
    """Whether a child doesn't repeat both its parent's value and evidence."""
    return ~(child_value.eqNullSafe(parent_value) & child_evidence.eqNullSafe(parent_evidence) & child_value.isNotNull())


def grouped_regions(lines: DataFrame, page: str, share: float = 0.2, gap: float = 24.0) -> DataFrame:
    """lines (page, line, x0, y0, x1, y1) with region: from the top each joins the region whose last line it overlaps most, by share of the
    narrower one, within that gap below; of equal ones that with the smaller gap, then the older one.

    The fold goes through a partition's sorted rows in Arrow batches and holds the last lines of one page's regions that reach within the
    gap of the line at hand; others no later line can join.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: list[tuple[int, float, float, float]] = []
        number = 0
        for batch in batches:
            out = []
            for first, left, top, right, bottom in zip(*[c.to_pylist() for c in batch.columns[-5:]], strict=True):
                if first:
                    last, number = [], 0
                best, found = None, -1
                near = []
                for region in last:
                    n, x0, x1, y1 = region
                    below = top - y1
                    if below > gap:
                        continue
                    near.append(region)
                    common = (min(x1, right) - max(x0, left)) / max(1e-9, min(x1 - x0, right - left))
                    if common >= share and below <= gap and (best is None or (common, -below) > best):
                        best, found = (common, -below), n
                if best is None:
                    found, number = number, number + 1
                    near.append((found, left, right, bottom))
                    last = near
                else:
                    last = [(n, left, right, bottom) if n == found else (n, x0, x1, y1) for n, x0, x1, y1 in near]
                out.append(found)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-5], pa.array(out, pa.int64())], names=[*batch.schema.names[:-5], "region"])

    # Unknown places come last.
    places = {c: F.coalesce(F.col(c).cast("double"), F.lit(math.nan)) for c in ("x0", "y0", "x1", "y1")}
    first = F.row_number().over(Window.partitionBy(page).orderBy(places["y0"], places["x0"], F.col("line").asc_nulls_last())) == 1
    marked = dealt(lines, page).select("*", first.alias("__first"), *[v.alias(f"__{c}") for c, v in places.items()])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in lines.schema)
    return marked.mapInArrow(fold, f"{schema}, region long")
