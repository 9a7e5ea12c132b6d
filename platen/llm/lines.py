"""Line dedup over overlapping windows of three lines, in DataFrame functions only.

Each run of three consecutive lines is a window under a 128-bit hash. Of equal windows in the whole corpus
the first, by key, text hash and place, stays; the lines of all later ones are covered, the covered places
of a document are merged, and the lines there go. Windows are counted with partial sums and met again by a
join that Spark can split, so a window that stands in a third of all documents makes no hot task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh

WINDOW = 3


def _windows(docs: DataFrame, key: str, text: str, window: int) -> DataFrame:
    lines = docs.where(F.col(key).isNotNull() & F.col(text).isNotNull())
    lines = lines.select(F.col(key).alias("key"), F.xxhash64(text).alias("th"), F.split(text, "\n", -1).alias("lines"))
    lines = lines.where(F.size("lines") >= window)
    own = lambda i: [F.get("lines", i + n) for n in range(window)]
    made = F.transform(
        F.sequence(F.lit(0), F.size("lines") - window),
        lambda i: F.struct(i.alias("pos"), F.xxhash64(*own(i)).alias("h1"), F.xxhash64(F.lit("second"), *own(i)).alias("h2")),
    )
    return lines.select("key", "th", F.inline(made))


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, removed: str = "removed") -> DataFrame:
    """docs with the lines of repeated windows removed from text, and removed array<int>: the places of these lines.

    A text of fewer lines than a window has none and stays, as do null texts and rows without a key, which
    count for nothing. Empty lines are lines. A text of which all lines go becomes empty. Windows that
    overlap in one text repeat as any other: of four equal lines the first stays. Repeated rows (key and
    text alike) are one occurrence and come out alike. An empty table gives an empty one. Other columns stay as they
    are, whatever their names; only one that is named as removed says is replaced by it.
    """
    windows = _windows(docs, key, text, window)
    place = F.struct("key", "th", "pos")
    repeated = windows.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1").drop("n")
    later = windows.join(repeated, ["h1", "h2"]).where(place != F.col("first"))
    later = later.groupBy("key", "th").agg(F.collect_set("pos").alias("later"))
    names = [x for x in docs.columns if x.lower() != removed.lower()]
    taken = [*docs.columns, removed]
    th, key2, th2, found, gone = (fresh(taken, x) for x in ("th", "key2", "th2", "later", "gone"))
    rows = docs.select(*names, F.xxhash64(text).alias(th))
    later = later.select(F.col("key").alias(key2), F.col("th").alias(th2), F.col("later").alias(found))
    rows = rows.join(later, (F.col(key) == F.col(key2)) & (F.col(th) == F.col(th2)), "left")
    covered = F.array_sort(F.array_distinct(F.flatten(F.transform(found, lambda p: F.sequence(p, p + window - 1)))))
    rows = rows.withColumn(gone, F.coalesce(covered, F.array().cast("array<int>")))
    lines = F.split(text, "\n", -1)
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone))
    left = F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n")
    rows = rows.withColumn(text, F.when(F.size(gone) > 0, left).otherwise(F.col(text)))
    return rows.select(*names, F.col(gone).alias(removed))
