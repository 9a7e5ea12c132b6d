"""Lines and runs out of ordered positions. Three definitions of a line, which are kept apart."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate
from math import nan
from operator import sub

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .grouping import dealt


def anchor_clusters(rows: DataFrame, group: list[str], y: str, x: str, size: str, index: str) -> DataFrame:
    """rows with cluster: a new one begins where y lies more than half the row's size from the cluster's first row.

    Rows are taken in the order (y, x, index), unknown values last. The anchor needs a fold, which goes through a partition's sorted
    rows in Arrow batches and holds one of them, not a group.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cluster, anchor = -1, nan
        for batch in batches:
            out = []
            for first, at, reach in zip(*[c.to_pylist() for c in batch.columns[-3:]], strict=True):
                if first:
                    cluster, anchor = 0, at
                elif abs(at - anchor) > reach:
                    cluster, anchor = cluster + 1, at
                out.append(cluster)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-3], pa.array(out, pa.int64())], names=[*batch.schema.names[:-3], "cluster"])

    number = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(nan))
    keys = [number(c) if dict(rows.dtypes)[c] in ("float", "double") else F.col(c).asc_nulls_last() for c in (y, x, index)]
    first = F.row_number().over(Window.partitionBy(*group).orderBy(*keys)) == 1
    marked = dealt(rows, *group).select("*", first.alias("__first"), number(y).alias("__at"), (0.5 * number(size)).alias("__reach"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return marked.mapInArrow(fold, f"{schema}, cluster long")


def chain_clusters(rows: DataFrame, group: list[str], order: list[str], value: Column, gap: Column) -> DataFrame:
    """rows with cluster: a new one begins where value lies more than gap from the row before."""
    w = Window.partitionBy(*group).orderBy(*order)
    new = F.coalesce(F.abs(value - F.lag(value).over(w)) > gap, F.lit(True))
    return rows.withColumn("__new", new.cast("long")).withColumn("cluster", F.sum("__new").over(w) - 1).drop("__new")


def merged_intervals(rows: DataFrame, group: list[str], start: str, stop: str, least: float) -> DataFrame:
    """rows with run: a new one begins where the gap to all before is least or more."""
    w = Window.partitionBy(*group).orderBy(start, stop)
    before = F.max(stop).over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.coalesce(F.col(start) - before >= least, F.lit(True))
    return rows.withColumn("__new", new.cast("long")).withColumn("run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).drop("__new")


def islands(rows: DataFrame, group: list[str], index: str, active: Column) -> DataFrame:
    """group, first, last, length of each run of consecutive active indices."""
    on = rows.where(active).withColumn("__k", F.col(index) - F.row_number().over(Window.partitionBy(*group).orderBy(index)))
    return on.groupBy(*group, "__k").agg(F.min(index).alias("first"), F.max(index).alias("last"), F.count("*").alias("length")).drop("__k")


#: Fixed value: white space, as Unicode lists it.
BLANK = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Words of an Arrow batch, about.
WORDS = 200_000


def _cut(texts: list[str | None]) -> Iterator[tuple[int, list[int], tuple[list, list, list, list]]]:
    """Of runs of texts, about WORDS words each: the first text, each one's number of words, and word_no, word, start, end."""
    parts = re.compile(f"[{BLANK}]+|[^{BLANK}]+").findall
    blank = re.compile(f"[{BLANK}]").match
    at, counts, columns = 0, [], ([], [], [], [])
    for n, line in enumerate(texts):
        found = parts(line or "")
        first = 1 if line and blank(line) else 0  # blanks and words take turns
        words, ends = found[first::2], list(accumulate(map(len, found)))[first::2]
        counts.append(len(words))
        for column, values in zip(columns, (range(len(words)), words, map(sub, ends, map(len, words)), ends), strict=True):
            column.extend(values)
        if len(columns[0]) >= WORDS:
            yield at, counts, columns
            at, counts, columns = n + 1, [], ([], [], [], [])
    yield at, counts, columns


WORD = pa.schema([("word_no", pa.int32()), ("word", pa.string()), ("start", pa.int32()), ("end", pa.int32())])


def words_of(lines: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, word_no, word, start, end: runs of other than white space, spans in code points. No shuffle.

    Spark's functions have running sums over an array only as a fold for each element, which takes ten times as long as this.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, counts, columns in _cut(batch.column(len(keys)).to_pylist()):
                row = pa.array(np.repeat(np.arange(at, at + len(counts), dtype=np.int32), counts))
                own = [batch.column(k).take(row) for k in range(len(keys))]
                yield pa.RecordBatch.from_arrays(own + [pa.array(x, f.type) for x, f in zip(columns, WORD, strict=True)], names=[*keys, *WORD.names])

    schema = ", ".join(f"`{k}` {lines.schema[k].dataType.simpleString()}" for k in keys)
    return lines.select(*keys, text).mapInArrow(run, f"{schema}, word_no int, word string, start int, end int")


def word_lists(lines: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, text, words: as words_of, but a row for each line, with its words as an array beside its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, counts, columns in _cut(batch.column(len(keys)).to_pylist()):
                words = pa.StructArray.from_arrays([pa.array(x, f.type) for x, f in zip(columns, WORD, strict=True)], fields=list(WORD))
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *counts]), pa.int32()), words)
                yield pa.RecordBatch.from_arrays([*batch.slice(at, len(counts)).columns, lists], names=[*keys, text, "words"])

    schema = ", ".join(f"`{k}` {lines.schema[k].dataType.simpleString()}" for k in [*keys, text])
    return lines.select(*keys, text).mapInArrow(run, f"{schema}, words array<struct<word_no: int, word: string, start: int, end: int>>")


def running_space(rows: DataFrame, group: list[str], order: list[str], top: str, bottom: str) -> DataFrame:
    """rows with space_before: from the lowest bottom of all before, at least 0; null for the first."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("space_before", F.when(F.max(bottom).over(w).isNotNull(), F.greatest(F.lit(0.0), F.col(top) - F.max(bottom).over(w))))
