"""Quality classifier: features of form, scored by a generalised additive model with pairwise interactions.

The model is fitted by the driver on at most SAMPLE labelled rows, those of the smallest hashed keys; all texts
are scored where they are read, by additions from tables that are broadcast (their size is fixed). No shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import Additive, fit
from .common import Words, blocks, mapped

SAMPLE = 20_000

_KINDS = np.full(256, 7, np.int64)  # bytes of other scripts
for _n, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:'\"?-()", b" \t\r", b"\n")):
    _KINDS[list(_chars)] = _n
for _b in range(128):
    if _KINDS[_b] == 7:
        _KINDS[_b] = 6  # other marks
FEATURES = (
    "bytes", "lower", "upper", "digit", "mark", "blank", "line", "odd", "other", "words", "word_bytes", "distinct",
    "distinct_pairs", "repeats", "most_common", "upper_words", "bare_words", "odd_ends", "line_words", "stops",
)


def features(texts: pa.Array) -> np.ndarray:
    """A row of FEATURES per text. A null or empty text has zeros."""
    texts = pc.fill_null(texts, "")
    n = len(texts)
    lengths = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    base = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset] if n else 0
    data = np.frombuffer(texts.buffers()[2], np.uint8)[base : base + offsets[-1]] if offsets[-1] else np.zeros(0, np.uint8)
    kinds = np.zeros((n, 8))
    for a in range(0, n, 256):
        z = min(n, a + 256)
        span = _KINDS[data[offsets[a] : offsets[z]]]
        span += np.repeat(np.arange(z - a, dtype=np.int64) * 8, lengths[a:z])
        kinds[a:z] = np.bincount(span, minlength=8 * (z - a)).reshape(-1, 8)
    size = np.maximum(lengths, 1)
    words = Words(texts, lower=True)
    upper = Words(texts, lower=False)
    count = np.maximum(words.sizes, 1)
    every = len(words.words)

    def distinct(codes: np.ndarray, doc: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
        found, times = np.unique(doc.astype(np.int64) * base + codes, return_counts=True)
        doc = found // base
        most = np.zeros(n)
        np.maximum.at(most, doc, times)
        return np.bincount(doc, minlength=n), most

    kinds_of_words, most = distinct(words.word, words.doc, max(every, 1))
    same = words.doc[1:] == words.doc[:-1]
    pair = (words.word[:-1].astype(np.int64) * every + words.word[1:])[same]
    base = max(every, 1) ** 2
    if base * max(n, 1) > 2**62:  # too many for one number with the row
        found, pair = np.unique(pair, return_inverse=True)
        base = max(len(found), 1)
    pairs, _ = distinct(pair, words.doc[1:][same], base)
    again = np.bincount(words.doc[1:][same & (words.word[1:] == words.word[:-1])], minlength=n)
    share = lambda mask, of: np.bincount(of.doc, weights=mask[of.word], minlength=n) / count
    flag = lambda of, pattern: pc.match_substring_regex(of.words, pattern).to_numpy(zero_copy_only=False).astype(float)
    out = np.empty((n, len(FEATURES)))
    out[:, 0] = np.log1p(lengths)
    out[:, 1:9] = kinds[:, [0, 1, 2, 3, 4, 5, 6, 7]] / size[:, None]
    out[:, 9] = np.log1p(words.sizes)
    out[:, 10] = (lengths - kinds[:, 4] - kinds[:, 5]) / count
    out[:, 11] = kinds_of_words / count
    out[:, 12] = pairs / np.maximum(words.sizes - 1, 1)
    out[:, 13] = again / count
    out[:, 14] = most / count
    out[:, 15] = share(flag(upper, r"[A-Z][A-Z]"), upper)
    out[:, 16] = share(flag(words, r"^[^\p{L}]+$"), words)
    out[:, 17] = share(flag(words, r"[^\p{L}\p{N}.,;:'\"?)!]$"), words)
    out[:, 18] = np.log1p(words.sizes / (kinds[:, 5] + 1))
    out[:, 19] = share(flag(words, r"[.!?]$"), words)
    return out


def _featured(docs: DataFrame, key: str, text: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, 1):
            x = features(block.column(1))
            flat = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1], x.ravel())
            yield pa.RecordBatch.from_arrays([block.column(0), flat], names=["key", "x"])

    kind = docs.schema[key].dataType.simpleString()
    return mapped(docs.select(key, text), run, f"key {kind}, x array<double>")


def labelled_sample(labels: DataFrame, key: str, label: str, rows: int) -> DataFrame:
    """key, y of at most that many rows: those of the smallest hashed keys. Null keys and labels are left out; of a key's labels the largest counts."""
    known = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(key).agg(F.max(F.col(label).cast("double")).alias("y"))
    return known.orderBy(F.xxhash64(key), key).limit(rows)


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> Additive:
    """The model of label, from the rows of docs that labels names; at most sample of them, those of the smallest hashed keys.

    Labels that are null or without a key are left out, of a key's labels the largest counts, and of its rows one. Rows
    of docs without a key teach nothing. Null texts are empty. Without rows, or with labels of one kind alone, every score is
    the same: 0.5 without any. Other columns are not read.
    """
    chosen = labelled_sample(labels, key, label, sample)
    # Of a bounded number of rows: at most sample keys and labels.
    texts = docs.select(key, text).join(F.broadcast(chosen), key)
    made = _featured(texts.select(key, text), key, text).join(F.broadcast(chosen.withColumnRenamed(key, "key")), "key")
    rows = sorted((r.key, tuple(r.x), r.y) for r in made.dropDuplicates(["key"]).collect())
    x = np.array([r[1] for r in rows]).reshape(-1, len(FEATURES))
    return fit(x, np.array([r[2] for r in rows]))


def score(docs: DataFrame, model: Additive, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, score: a row per row of docs, repeated ones and those without a key too.

    Null and empty texts have the score of an empty text. An empty table gives an empty one; other columns are not read."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, 1):
            yield pa.RecordBatch.from_arrays([block.column(0), pa.array(shared.value.score(features(block.column(1))))], names=[key, "score"])

    kind = docs.schema[key].dataType.simpleString()
    return mapped(docs.select(key, text), run, f"`{key}` {kind}, score double")


def keep_good(docs: DataFrame, model: Additive, least: float, text: str = "text") -> DataFrame:
    """The rows of docs, all columns whatever their names, whose text scores at least that; see score()."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, at):
            yield block.filter(pa.array(shared.value.score(features(block.column(at))) >= least))

    return mapped(docs, run, docs.schema)
