"""What the operators of this package share: inputs, shared folders, word blocks, components."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python worker holds at a time, beyond one text.
BLOCK_BYTES = 6 << 20
#: Bits of the table that sifted() broadcasts, at most 262,144 rows.
SIFTED = 1 << 24


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(key: str, mod: int) -> Column:
    """crc32 of the key as text, modulo mod; a null key has the remainder of an empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % mod


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else (local runs and tests) a temporary one."""
    sc = spark.sparkContext
    at = sc.getConf().get("spark.checkpoint.dir", "") or (sc.getCheckpointDir() or "")
    if not at:
        if sc.master.partition("[")[0] != "local":
            raise ValueError("executors share no temporary folder: set spark.checkpoint.dir")
        at = tempfile.mkdtemp(prefix="platen-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(at)
    return at


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/platen/{name}-{uuid.uuid4().hex}"


_open: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes on leaving the tables that stored() wrote inside; nothing read from them may outlive it."""
    _open.append([])
    try:
        yield
    finally:
        for path in _open.pop():
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def stored(df: DataFrame, name: str, *, outer: bool = False) -> DataFrame:
    """df written to the shared folder and read again: what is lost with an executor is not computed anew.

    With outer the table belongs to the scratch() around the innermost one."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    if len(_open) > outer:
        _open[-1 - outer].append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def batches_of(spark: SparkSession, size: int) -> Iterator[None]:
    """Python workers of what runs inside get their rows in batches of about size bytes; Spark's own bound is 10,000 rows or 64 MB."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    old = spark.conf.get(name)
    spark.conf.set(name, str(size))
    try:
        yield
    finally:
        spark.conf.set(name, old)


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def fresh(taken: list[str], name: str) -> str:
    """name, with underscores before it until no column has it (Spark's names differ in more than case)."""
    low = {x.lower() for x in taken}
    while name.lower() in low:
        name = "_" + name
    return name


def sifted(rows: DataFrame, keys: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The rows that may have one of keys (of the same column), and the rest, which have none: a join of the former alone moves less.

    Told by SIFTED bits under hashed keys, a table of bounded size, so it is broadcast. With many more keys than bits most rows may have one.
    """
    at = F.pmod(F.xxhash64(key), F.lit(SIFTED))
    word, bits, own = (fresh(rows.columns, x) for x in ("word", "bits", "own"))
    mask = lambda x: F.expr(f"shiftleft(1L, cast(`{x}` % 64 AS int))")
    held = keys.select(at.alias(own)).groupBy(F.floor(F.col(own) / 64).alias(word)).agg(F.bit_or(mask(own)).alias(bits))
    told = rows.withColumn(own, at).withColumn(word, F.floor(F.col(own) / 64)).join(F.broadcast(held), word, "left")
    may = F.coalesce(F.col(bits).bitwiseAND(mask(own)), F.lit(0).cast("long")) != 0
    return tuple(told.where(x).select(*[F.col(f"`{c}`") for c in rows.columns]) for x in (may, ~may))


def release() -> None:
    """Gives memory that is free in this Python process back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library than glibc


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: object) -> DataFrame:
    """df.mapInArrow(run, schema); a worker, which Spark keeps for later tasks, ends each task with no more memory than it began with."""

    def lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return df.mapInArrow(lean, schema)


def blocks(batches: Iterable[pa.RecordBatch], text: int, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows in their order, in blocks of about limit bytes of column number text; a longer text has a block with few others."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        at, start, total = 0, 0, size
        for end in range(1, len(lengths) + 1):
            total += lengths[end - 1]
            if total >= limit:
                held.append(batch.slice(start, end - start))
                yield joined(held)
                held, total, start = [], 0, end
        at = start
        if at < len(lengths):
            held.append(batch.slice(at))
        size = total
    if held:
        yield joined(held)


def joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return batches[0] if len(batches) == 1 else pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


class Words:
    """The words of a block: documents as rows, words by their number in a dictionary of distinct words.

    doc: per word the row; word: per word its number; words: the distinct words; n: rows.
    A word is a run of bytes other than 0x20 and 0x09-0x0D. Null texts are empty.
    """

    def __init__(self, texts: pa.Array, *, lower: bool) -> None:
        texts = pc.fill_null(texts, "")
        if lower:
            texts = pc.ascii_lower(texts)
        split = pc.ascii_split_whitespace(texts)
        flat = split.flatten()
        sizes = np.diff(split.offsets.to_numpy())
        doc = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
        keep = pc.greater(pc.binary_length(flat), 0)
        flat = flat.filter(keep)
        self.doc = doc[keep.to_numpy(zero_copy_only=False)]
        coded = flat.dictionary_encode()
        self.word = coded.indices.to_numpy()
        self.words = coded.dictionary
        self.n = len(texts)
        self.sizes = np.bincount(self.doc, minlength=self.n)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])


def gather(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The positions of the ranges that begin at starts and have these sizes, one after the other."""
    total = int(sizes.sum())
    shift = np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) if len(sizes) else np.zeros(0, np.int64)
    return np.arange(total, dtype=np.int64) + shift


def spanning(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For nodes 0..n-1 with links a-b, the smallest node of each node's component."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        while True:
            jumped = root[root]
            if (jumped == root).all():
                break
            root = jumped
        if (root == before).all():
            break
    return root


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of the nodes of edges (a, b): component is the smallest node that can be reached.

    Labels fall to the smallest neighbour's label; then every label takes the smallest label seen by
    any of its holders, so that whole groups move at once. Each round is an aggregate with partial
    sums and joins that Spark can split; a round's labels are checkpointed. No group is gathered.
    """
    pairs = edges.select("a", "b").where("a <> b")
    pairs = cut(pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(pairs.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")))
    while True:
        seen = (
            pairs.join(labels, pairs.b == labels.node).groupBy("a").agg(F.min("label").alias("seen")).withColumnRenamed("a", "node")
        )
        near = labels.join(seen, "node").select("node", "label", F.least("label", "seen").alias("near"))
        near = cut(near)
        best = near.groupBy(F.col("label").alias("old")).agg(F.min("near").alias("best"))
        moved = cut(near.join(best, near.label == best.old).select("node", "best", (F.col("label") != F.col("best")).alias("changed")))
        jump = moved.select(F.col("node").alias("via"), F.col("best").alias("next"))
        labels = cut(
            moved.join(jump, moved.best == jump.via, "left").select("node", F.least("best", F.coalesce("next", "best")).alias("label"))
        )
        if moved.where("changed").isEmpty():
            return labels.select("node", F.col("label").alias("component"))
