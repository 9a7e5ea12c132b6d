"""Reports and files: absent measurements stay visible, keys keep their order, nothing is overwritten."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platen.functions.text import escaped


def metric(x: Column, digits: int = 3) -> Column:
    """Fixed decimals; n/a where nothing was measured, never 0."""
    return F.when(x.isNull() | F.isnan(x), "n/a").otherwise(F.format_string(f"%.{digits}f", x))


def text_report(summary: DataFrame, key: str) -> DataFrame:
    """key, report of seven lines. summary: matched, total_left, total_right, median_dx, median_dy, max_dx, max_dy."""
    lines = [
        F.format_string("matched: %d", "matched"),
        F.format_string("left: %d", "total_left"),
        F.format_string("right: %d", "total_right"),
        *[F.concat(F.lit(f"{name}: "), metric(F.col(name))) for name in ("median_dx", "median_dy", "max_dx", "max_dy")],
    ]
    return summary.select(key, F.concat_ws("\n", *lines).alias("report"))


def as_json(columns: list[Column]) -> Column:
    """An object with these keys in this order; null stays null."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def grouped_json(head: DataFrame, key: str, lists: dict[str, tuple[DataFrame, list[str], list[str]]]) -> DataFrame:
    """key, json: head's columns, then for each name the group's rows as a list: (rows, order, fields).

    A report holds the rows of one document, which bounds its lists.
    """
    out = head
    for name, (rows, order, fields) in lists.items():
        item = F.struct(F.struct(*order).alias("o"), F.struct(*fields).alias("v"))
        made = rows.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["v"]).alias(name))
        out = out.join(made, key, "left").withColumn(name, F.coalesce(F.col(name), F.array().cast(made.schema[name].dataType)))
    return out.select(key, as_json([F.col(c) for c in out.columns]).alias("json"))


def canonical_number(x: Column) -> Column:
    """Shortest decimals without exponent, trailing zeros or a negative zero."""
    plain = F.format_string("%.9f", x)
    short = F.regexp_replace(F.regexp_replace(plain, r"0+$", ""), r"\.$", "")
    return F.when(short == "-0", "0").otherwise(short)


def typeset(lines: DataFrame, page: str, order: str) -> DataFrame:
    """page, source: one placed box per line (x, y, size, family, text), in order; null if a line lacks any of these."""
    parts = [F.lit('#place(dx: '), canonical_number(F.col("x")), F.lit("pt, dy: "), canonical_number(F.col("y")), F.lit("pt, text(size: "), canonical_number(F.col("size")), F.lit('pt, font: "'), escaped(F.col("family")), F.lit('", "'), escaped(F.col("text")), F.lit('"))')]
    rows = lines.withColumn("__line", F.concat(*parts))
    made = rows.groupBy(page).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("__line").alias("l")))).alias("ls"), F.bool_or(F.col("__line").isNull()).alias("lacks"))
    return made.select(page, F.when(~F.col("lacks"), F.array_join(F.transform("ls", lambda x: x["l"]), "\n")).alias("source"))


def publish(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """Writes where nothing is yet; an error otherwise. Spark commits the files of a job together at its end."""
    df.write.mode("errorifexists").format(kind).save(path)


def glyph_catalogue(glyphs: DataFrame, fonts: DataFrame, page: str) -> DataFrame:
    """page, json: glyphs with their base font, which is null for a font that isn't listed."""
    rows = glyphs.join(fonts.select("font", "base_font"), "font", "left")
    fields = ["glyph_index", "code", "x", "y", "advance", "font", "base_font", "size"]
    return grouped_json(rows.select(page).distinct(), page, {"glyphs": (rows, ["glyph_index"], fields)})
