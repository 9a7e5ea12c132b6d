"""Checks of units, references and configurations. All violations are reported; the first by order is the verdict."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut


def duplicate_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def dangling(rows: DataFrame, reference: str, targets: DataFrame, key: str) -> DataFrame:
    """Rows whose reference is given but names no target."""
    return rows.where(F.col(reference).isNotNull()).join(targets.select(F.col(key).alias(reference)).distinct(), reference, "left_anti")


def sibling_order(rows: DataFrame, group: list[str], parent: str, order: str) -> DataFrame:
    """Orders that siblings share; roots are siblings of each other."""
    return rows.where(F.col(order).isNotNull()).groupBy(*group, F.coalesce(F.col(parent).cast("string"), F.lit("")).alias("siblings"), order).agg(F.count("*").alias("n")).where("n > 1")


def cyclic(edges: DataFrame, node: str, up: str) -> DataFrame:
    """node: those that lie on a cycle or reach one, by pointer doubling over single parents; at most as many rounds as the longest
    chain has bits. Each round is checkpointed, so the plan doesn't grow, and it ends when no pointer is left."""
    known = cut(edges.select(F.col(node).alias("n"), F.col(up).alias("u")))
    for _ in range(max(1, known.count()).bit_length() + 1):
        open_ = known.where("u IS NOT NULL")
        known = cut(open_.join(known.select(F.col("n").alias("m"), F.col("u").alias("uu")), F.col("u") == F.col("m"), "left").select("n", F.col("uu").alias("u")))
        if known.where("u IS NOT NULL").isEmpty():
            break
    return known.where("u IS NOT NULL").select(F.col("n").alias(node))


def span_errors(units: DataFrame, unit: str = "unit_id", parent: str = "parent_id", text: str = "text", start: str = "start", end: str = "end") -> DataFrame:
    """Children whose text isn't that of their span in the parent's text; spans count code points from 0."""
    parents = units.select(F.col(unit).alias("__p"), F.col(text).alias("__text"))
    rows = units.where(F.col(parent).isNotNull() & F.col(start).isNotNull()).join(parents, F.col(parent) == F.col("__p"))
    inside = (F.col(start) >= 0) & (F.col(end) > F.col(start)) & (F.col(end) <= F.length("__text"))
    same = F.substring(F.col("__text"), F.col(start) + 1, F.col(end) - F.col(start)) == F.col(text)
    return rows.where(~(inside & F.coalesce(same, F.lit(False)))).select(unit)


def span_errors_within(rows: DataFrame, keys: list[str], text: str, children: str, child: str) -> DataFrame:
    """keys, child of the same errors, where children (an array of child, text, start, end) lie beside their parent's text. No shuffle.

    Spark's substring walks the whole text for each child, so a long text takes the square of its length; here a child takes its own.
    """

    def wrong(whole: str | None, part: str | None, start: int, end: int | None) -> bool:
        return not (whole is not None and end is not None and 0 <= start < end <= len(whole) and whole[start:end] == part)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole_batch in batches:
            for at in range(0, whole_batch.num_rows, 1000):
                batch = whole_batch.slice(at, 1000)
                texts, lists = batch.columns[-2:]
                counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
                owner = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
                names, *fields = lists.flatten().flatten()
                wholes = np.repeat(np.array(texts.to_pylist(), object), counts)
                bad = np.fromiter(map(wrong, wholes, *[x.to_pylist() for x in fields]), bool, len(owner))
                own = pa.array(owner[bad])
                yield pa.RecordBatch.from_arrays([*[c.take(own) for c in batch.columns[:-2]], names.filter(pa.array(bad))], names=[*keys, child])

    parts = F.transform(children, lambda c: F.struct(c[child].alias("n"), c["text"].alias("t"), c["start"].alias("s"), c["end"].alias("e")))
    made = rows.select(*keys, text, F.filter(parts, lambda c: c["s"].isNotNull()).alias("__parts"))
    kinds = dict(rows.select(*keys, F.get(children, F.lit(0))[child].alias(child)).dtypes)
    return made.mapInArrow(run, ", ".join(f"`{k}` {kinds[k]}" for k in [*keys, child]))


def first_violation(rows: DataFrame, key: str, checks: list[tuple[str, str]]) -> DataFrame:
    """key, violation: the first check whose condition (SQL) holds, in this order; every row, null where none does."""
    found = F.coalesce(*[F.when(F.expr(condition), name) for name, condition in checks])
    return rows.select(key, found.alias("violation"))


def incoherent_coverage(matches: DataFrame, left: DataFrame, right: DataFrame, left_id: str, right_id: str) -> DataFrame:
    """One row: whether matched pairs are a bijection within both sides, and how many of each side are matched."""
    count = lambda df, name: df.agg(F.count("*").alias(name))
    made = matches.agg(F.count("*").alias("matched"), F.count_distinct(left_id).alias("lefts"), F.count_distinct(right_id).alias("rights"))
    inside = matches.join(left.select(left_id), left_id, "left_semi").join(right.select(right_id), right_id, "left_semi")
    row = made.join(F.broadcast(count(left, "total_left")), F.lit(True)).join(F.broadcast(count(right, "total_right")), F.lit(True)).join(F.broadcast(count(inside, "inside")), F.lit(True))
    return row.select("matched", "total_left", "total_right", ((F.col("matched") == F.col("lefts")) & (F.col("matched") == F.col("rights")) & (F.col("inside") == F.col("matched"))).alias("coherent"))


def contiguous(ranges: DataFrame, group: list[str], start: str, stop: str, total: str) -> DataFrame:
    """group, covers: whether ranges begin at 1, follow each other without gap or overlap, and end at total."""
    before = F.lag(stop).over(Window.partitionBy(*group).orderBy(start, stop))
    rows = ranges.withColumn("__ok", (F.col(start) == F.coalesce(before, F.lit(0)) + 1) & (F.col(stop) >= F.col(start)))
    return rows.groupBy(*group).agg((F.bool_and("__ok") & (F.max(stop) == F.max(total))).alias("covers"))


def page_diagnosis(operations: DataFrame, page: str, operator: str, kind: str) -> DataFrame:
    """page, diagnosis of pages without text: image-only where an image is drawn, else no-text."""
    made = operations.groupBy(page).agg(F.bool_or(F.col(operator).isin("Tj", "TJ")).alias("text"), F.bool_or((F.col(operator) == "Do") & (F.col(kind) == "Image")).alias("image"))
    return made.where(~F.coalesce("text", F.lit(False))).select(page, F.when(F.coalesce("image", F.lit(False)), "image-only").otherwise("no-text").alias("diagnosis"))


def topological(nodes: dict[str, set[str]]) -> list[str]:
    """Nodes after what they need, the smallest name first; an error for a cycle or an unknown name."""
    missing = {x for needs in nodes.values() for x in needs} - set(nodes)
    if missing:
        raise ValueError(f"unknown: {sorted(missing)}")
    left, out = {k: set(v) for k, v in nodes.items()}, []
    while left:
        ready = min((k for k, v in left.items() if not v), default=None)
        if ready is None:
            raise ValueError(f"a cycle through {sorted(left)}")
        out.append(ready)
        del left[ready]
        for v in left.values():
            v.discard(ready)
    return out
