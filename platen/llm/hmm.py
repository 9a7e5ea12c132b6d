"""Language-model scores by a hidden Markov model over words.

A state emits a class of words (short words under their own hash, longer ones under that of their ending),
and a class emits its words by their counts in the training texts; an unseen word has its class's share of
half a count. Latent states are trained by Baum-Welch: each task sums expected counts of its texts, Spark
adds them up. The scaled forward recursion gives a text's exact likelihood.

Texts are read once, into blocks: word numbers in order, and the block's distinct words, dealt out by hash into buckets.
Counts of words are added up in two steps, so that a word of every block makes no large group: in each bucket first
over the blocks of a span, then over spans, where a word stands once for each. Totals return the same way, and what
moves is each block's vocabulary. The number of buckets grows with the input's. The model itself has a fixed size.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Words, batches_of, blocks, mapped, stored

STATES, ITERATIONS, CLASSES = 8, 4, 2048
BLOCK = 3 << 20
#: Blocks that a training step takes at once: a step for each position of the longest text costs as much for few texts.
TOGETHER = 2
#: Blocks whose words are added up in one group.
SPAN = 128
#: Words of at most so many bytes have classes by themselves; of longer ones the last bytes count.
SHORT, ENDING = 5, 3


def word_class(word: bytes) -> int:
    return zlib.crc32(word if len(word) <= SHORT else b"\x00" + word[-ENDING:]) % CLASSES


@dataclass
class Model:
    """start: states; step: states by states; emit: classes and the end (the last) by states."""

    start: np.ndarray
    step: np.ndarray
    emit: np.ndarray

    @staticmethod
    def initial(shares: np.ndarray, states: int, seed: int = 7) -> Model:
        noise = np.random.default_rng(seed)
        emit = shares[:, None] * np.exp(1.5 * noise.standard_normal((len(shares), states)))
        step = np.full((states, states), 0.05 / max(1, states - 1))
        np.fill_diagonal(step, 0.95 if states > 1 else 1.0)
        return Model(np.full(states, 1 / states), step, emit / emit.sum(axis=0))


class Layout:
    """The tokens of a block's texts by time: longest text first, all first tokens, then all second ones, and so on."""

    def __init__(self, sizes: np.ndarray) -> None:
        self.order = np.argsort(-sizes, kind="stable")
        rank = np.empty(len(sizes), np.int64)
        rank[self.order] = np.arange(len(sizes))
        longest = int(sizes.max()) if len(sizes) else 0
        live = len(sizes) - np.searchsorted(np.sort(sizes), np.arange(longest), side="right")
        self.at = np.concatenate([[0], np.cumsum(live)]).astype(np.int64)
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(sizes) else sizes
        time = np.arange(int(sizes.sum())) - np.repeat(starts, sizes)
        self.place = self.at[time] + np.repeat(rank, sizes)
        self.rank = rank


def forward(model: Model, classes: np.ndarray, layout: Layout, keep: bool) -> tuple[np.ndarray, np.ndarray | None, np.ndarray | None]:
    """Per text (in the layout's order) the log of its likelihood; with keep also the scaled forward values and the scales."""
    kind = np.float32 if keep else np.float64
    emit, step = model.emit.astype(kind), model.step.astype(kind)
    bounds = layout.at.tolist()
    n = bounds[1] if len(bounds) > 1 else 0
    logs = np.zeros(n)
    values = np.empty((len(classes), len(model.start)), kind) if keep else None
    scales = np.empty(len(classes), kind) if keep else None
    now = np.broadcast_to(model.start.astype(kind), (n, len(model.start)))
    for t, (a, z) in enumerate(zip(bounds, bounds[1:], strict=False)):
        now = (now[: z - a] @ step if t else now) * emit[classes[a:z]]
        scale = now.sum(axis=1)
        now = now / scale[:, None]
        logs[: z - a] += np.log(scale)
        if keep:
            values[a:z], scales[a:z] = now, scale
    return logs, values, scales


def expected(model: Model, classes: np.ndarray, layout: Layout) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Expected counts of starts, steps and emissions over the block's texts, and their log likelihood."""
    logs, values, scales = forward(model, classes, layout, True)
    states = len(model.start)
    emit, step = model.emit.astype(np.float32), model.step.astype(np.float32)
    back = step.T.copy()
    bounds = layout.at.tolist()
    moves = np.zeros((states, states))
    later = np.zeros((0, states), np.float32)
    for t in range(len(bounds) - 2, -1, -1):
        a, z = bounds[t], bounds[t + 1]
        beta = np.ones((z - a, states), np.float32)
        if len(later):
            beta[: len(later)] = later @ back
            moves += values[a : a + len(later)].T @ later
        later = emit[classes[a:z]] * beta / scales[a:z, None]
        values[a:z] *= beta
    counts = np.stack([np.bincount(classes, values[:, k], len(model.emit)) for k in range(states)], axis=1)
    start = values[: bounds[1]].sum(axis=0) if len(bounds) > 1 else np.zeros(states)
    return start.astype(float), moves * model.step, counts, float(logs.sum())


def _packed(numbers: np.ndarray) -> bytes:
    """int32 numbers, all lowest bytes first, compressed: a block's are the longest values that Spark moves."""
    return pa.compress(np.ascontiguousarray(numbers.view(np.uint8).reshape(-1, 4).T), codec="zstd", asbytes=True)


def _unpacked(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, 4 * n, codec="zstd"), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view(np.int32).ravel()


def _read(docs: DataFrame, key: str, text: str, train: Column, buckets: int) -> DataFrame:
    """kind 0: a block, its keys, whether they train, sizes, packed word numbers, words' classes. kind 1: for
    each bucket the block's words of that hash, in their order, their classes and counts in training texts.

    Both kinds go to one file of a task, in columns of their own, so that either is read without the other and neither is sorted."""
    kind = docs.schema[key].dataType.simpleString()
    names = ["kind", "block", "bucket", "keys", "train", "sizes", "word", "of", "data", "classes", "counts"]
    schema = f"kind int, block long, bucket int, keys array<{kind}>, train array<boolean>, sizes array<int>, word binary, of binary, data binary, classes binary, counts binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for rows in blocks(batches, 1, BLOCK):
            seen = Words(rows.column(1), lower=True)
            words = seen.words.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist() if len(seen.words) else []
            classes = np.fromiter(map(word_class, words), np.uint16, len(words))
            trains = rows.column(2).to_numpy(zero_copy_only=False).astype(bool)
            counts = np.bincount(seen.word[trains[seen.doc]], minlength=len(words)).astype(np.int32)
            bucket = np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % buckets
            order = np.argsort(bucket, kind="stable")
            bounds = np.searchsorted(bucket[order], np.arange(buckets + 1))
            # Words are numbered by bucket, so that counts come back as runs.
            place = np.empty(len(words), np.int32)
            place[order] = np.arange(len(words), dtype=np.int32)
            made = [(0, number, -1, rows.column(0).to_pylist(), trains.tolist(), seen.sizes.tolist(), _packed(place[seen.word]), classes[order].tobytes(), None, None, None)]
            for b in range(buckets):
                part = order[bounds[b] : bounds[b + 1]]
                if len(part):
                    made.append((1, number, b, None, None, None, None, None, b" ".join([words[k] for k in part.tolist()]), classes[part].tobytes(), counts[part].tobytes()))
            kinds = [pa.int32(), pa.int64(), pa.int32(), pa.list_(rows.column(0).type), pa.list_(pa.bool_()), pa.list_(pa.int32()), *[pa.binary()] * 5]
            for some in (made[:1], made[1:]):
                if some:
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*some, strict=True), kinds, strict=True)], names=names)
            number += 1

    return mapped(docs.select(key, text, train.alias("train")), run, schema)


def _distinct(rows: pa.Table, order: str) -> tuple[pa.Table, np.ndarray, pa.Array, np.ndarray]:
    """Rows in the order of a column; per word of theirs its number, the distinct words in order of appearance, bounds of rows."""
    rows = rows.sort_by(order)
    lists = pc.split_pattern(rows.column("data").combine_chunks(), b" ")
    coded = lists.flatten().dictionary_encode()
    return rows, coded.indices.to_numpy(), coded.dictionary, lists.offsets.to_numpy()


def _count(words: DataFrame, spans: int) -> tuple[DataFrame, DataFrame]:
    """Of kind 1 rows: (block, bucket, counts) with each block's words' counts over all training texts; (class, tokens, words)."""
    words = words.select("block", "bucket", "data", "classes", "counts", F.pmod(F.xxhash64("block"), F.lit(spans)).cast("int").alias("span"))

    def over_blocks(rows: pa.Table) -> pa.Table:
        rows, code, distinct, _ = _distinct(rows, "block")
        total = np.bincount(code, np.frombuffer(b"".join(rows.column("counts").to_pylist()), np.int32), len(distinct)).astype(np.int64)
        of = np.zeros(len(distinct), np.uint16)
        of[code] = np.frombuffer(b"".join(rows.column("classes").to_pylist()), np.uint16)
        joined = b" ".join(distinct.to_pylist())
        one = {"bucket": rows.column("bucket")[:1], "span": rows.column("span")[:1]}
        return pa.table(one | {"data": pa.array([joined], pa.binary()), "classes": pa.array([of.tobytes()], pa.binary()), "counts": pa.array([total.tobytes()], pa.binary())})

    kind = "bucket int, span int, data binary, classes binary, counts binary"
    sums = stored(words.groupBy("bucket", "span").applyInArrow(over_blocks, kind), "spans")

    def over_spans(rows: pa.Table) -> pa.Table:
        rows, code, distinct, bounds = _distinct(rows, "span")
        total = np.bincount(code, np.frombuffer(b"".join(rows.column("counts").to_pylist()), np.int64), len(distinct)).astype(np.int64)
        of = np.zeros(len(distinct), np.int64)
        of[code] = np.frombuffer(b"".join(rows.column("classes").to_pylist()), np.uint16)
        tokens = np.bincount(of, total, CLASSES).astype(np.int64)
        kinds = np.bincount(of[total > 0], minlength=CLASSES)
        back = [total[code[a:z]].tobytes() for a, z in zip(bounds, bounds[1:], strict=False)]
        used = np.flatnonzero(tokens)
        n, m = len(back), len(used)
        return pa.table({
            "bucket": pa.array([rows.column("bucket")[0].as_py()] * (n + m), pa.int32()),
            "span": pa.array(rows.column("span").to_pylist() + [None] * m, pa.int32()),
            "counts": pa.array(back + [None] * m, pa.binary()),
            "class": pa.array([None] * n + used.tolist(), pa.int32()),
            "tokens": pa.array([None] * n + tokens[used].tolist(), pa.int64()),
            "words": pa.array([None] * n + kinds[used].tolist(), pa.int64()),
        })

    kind = "bucket int, span int, counts binary, class int, tokens long, words long"
    totals = stored(sums.groupBy("bucket").applyInArrow(over_spans, kind), "totals")

    def to_blocks(rows: pa.Table) -> pa.Table:
        own = pc.is_valid(rows.column("block"))
        total = np.frombuffer(rows.filter(pc.invert(own)).column("totals")[0].as_py(), np.int64)
        rows, code, _, bounds = _distinct(rows.filter(own), "block")
        back = [total[code[a:z]].tobytes() for a, z in zip(bounds, bounds[1:], strict=False)]
        return pa.table({"block": rows.column("block"), "bucket": rows.column("bucket"), "counts": pa.array(back, pa.binary())})

    summed = totals.where("span IS NOT NULL").select("bucket", "span", F.col("counts").alias("totals"))
    both = words.select("block", "bucket", "span", "data").unionByName(summed, allowMissingColumns=True)
    back = both.groupBy("bucket", "span").applyInArrow(to_blocks, "block long, bucket int, counts binary")
    return back, totals.where("span IS NULL").select("class", "tokens", "words")


def _tokens(row: dict, chosen: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a kind 0 row: words' classes and numbers in the texts' order, and the texts' sizes; of chosen texts only."""
    sizes = np.array(row["sizes"], np.int64)
    word = _unpacked(row["word"], int(sizes.sum()))
    of = np.frombuffer(row["of"], np.uint16)
    if chosen is not None:
        word = word[np.repeat(chosen, sizes)]
        sizes = sizes[chosen]
    return of[word], word, sizes


def _laid(words: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, Layout]:
    """Classes of tokens, the texts' ends among them, by time, and their layout."""
    ends = np.cumsum(sizes + 1) - 1
    flat = np.full(int(sizes.sum()) + len(sizes), CLASSES, np.int64)
    inner = np.ones(len(flat), bool)
    inner[ends] = False
    flat[inner] = words
    layout = Layout(sizes + 1)
    out = np.empty_like(flat)
    out[layout.place] = flat
    return out, layout


def baum_welch(texts: DataFrame, shares: np.ndarray, states: int, iterations: int) -> Model:
    """texts: kind 0 rows. Expected counts are added up by Spark; the driver gets a row per parameter."""
    model = Model.initial(shares, states)
    spark = texts.sparkSession
    for _ in range(iterations):
        shared = spark.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            total = np.zeros(states + states * states + (CLASSES + 1) * states)
            for batch in batches:
                made = [row for row in batch.to_pylist() if any(row["train"])]
                for at in range(0, len(made), TOGETHER):
                    words, _, sizes = map(np.concatenate, zip(*(_tokens(row, np.array(row["train"], bool)) for row in made[at : at + TOGETHER]), strict=True))
                    start, moves, counts, _ = expected(shared.value, *_laid(words, sizes))
                    total += np.concatenate([start, moves.ravel(), counts.ravel()])
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["i", "n"])

        rows = mapped(texts.select("train", "sizes", "word", "of"), run, "i long, n double").groupBy("i").agg(F.sum("n").alias("n")).collect()
        total = np.zeros(states + states * states + (CLASSES + 1) * states)
        for r in rows:
            total[r.i] = r.n
        start, moves, counts = np.split(total, [states, states + states * states])
        start, moves, counts = start + 0.1, moves.reshape(states, states) + 0.1, counts.reshape(-1, states) + 2 * shares[:, None]
        model = Model(start / start.sum(), moves / moves.sum(axis=1, keepdims=True), counts / counts.sum(axis=0))
    return model


def scores(docs: DataFrame, train: Column, key: str = "doc_id", text: str = "text", states: int = STATES, iterations: int = ITERATIONS) -> DataFrame:
    """key, train, n_tokens, n_known, train_tokens, base_score, score: a row per row of docs.

    Texts are lower-cased in ASCII; words are runs of bytes that aren't ASCII white space; each text ends with an end
    token. Rows where train holds are learnt from. score is the log10 of the model's probability of the text, base_score
    that of single tokens with half a count added. A null or empty text has the end alone. Without training
    rows both know no word. Repeated rows count, and are scored, each time, and so do rows without a key; other columns are
    not read; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    kind = docs.schema[key].dataType.simpleString()
    with batches_of(spark, BLOCK):
        read = stored(_read(docs, key, text, train, int(spark.conf.get("spark.sql.shuffle.partitions"))), "words")
    texts = read.where("kind = 0").select("kind", "block", "keys", "train", "sizes", "word", "of")
    counted, sums = _count(read.where("kind = 1"), -(-texts.count() // SPAN) or 1)
    sums = sums.groupBy("class").agg(F.sum("tokens").alias("tokens"), F.sum("words").alias("words")).collect()  # a row per class
    tokens, words = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in sums:
        tokens[r["class"]], words[r["class"]] = r.tokens, r.words
    ends = int(texts.select(F.sum(F.size(F.filter("train", lambda x: x)))).first()[0] or 0)
    every, distinct = int(tokens.sum()) + ends, int(words.sum()) + (ends > 0)
    shares = (np.append(tokens, ends) + 0.5) / (every + 0.5 * (CLASSES + 1))
    model = baum_welch(texts, shares, states, iterations)
    inside = np.log10(tokens + 0.5 * (words + 1))
    shared = spark.sparkContext.broadcast((model, inside))
    bottom = np.log10(every + 0.5 * (distinct + 1))

    def run(rows: pa.Table) -> pa.Table:
        model, inside = shared.value
        made = rows.to_pylist()
        row = next(r for r in made if r["kind"] == 0)
        counts = np.frombuffer(b"".join(r["counts"] for r in sorted((r for r in made if r["kind"] == 1), key=lambda r: r["bucket"])), np.int64)
        words, word, sizes = _tokens(row)
        classes, layout = _laid(words, sizes)
        doc = np.repeat(np.arange(len(sizes)), sizes)
        of = np.frombuffer(row["of"], np.uint16)
        logs = np.log10(counts + 0.5)
        top = np.bincount(doc, logs[word], len(sizes))
        within = np.bincount(doc, (logs - inside[of])[word], len(sizes))
        known = np.bincount(doc, (counts > 0)[word], len(sizes)).astype(np.int64) + (ends > 0)
        likely = np.empty(len(sizes))
        likely[layout.order] = forward(model, classes, layout, False)[0] / np.log(10)
        return pa.table({
            key: pa.array(row["keys"], rows.schema.field("keys").type.value_type),
            "train": pa.array(row["train"], pa.bool_()),
            "n_tokens": pa.array(sizes + 1),
            "n_known": pa.array(known),
            "train_tokens": pa.array(np.full(len(sizes), every)),
            "base_score": pa.array(top + np.log10(ends + 0.5) - (sizes + 1) * bottom),
            "score": pa.array(likely + within),
        })

    both = texts.unionByName(counted.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    schema = f"`{key}` {kind}, train boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return both.groupBy("block").applyInArrow(run, schema)
