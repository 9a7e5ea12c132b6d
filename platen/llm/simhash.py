"""SimHash near-duplicates: positional byte index with count filtering.

Fingerprints of 64 bits over word shingles link at a Hamming distance of at most 3. Such fingerprints
share at least 5 of their 8 bytes in place. Every 5 of 8 positions hold 3 positions of the same half,
so postings under (3 positions of a half, their 3 bytes) meet each such pair; there are 8 such triples.
Pairs that meet are tallied over all 8 positions, those with 5 or more equal bytes are verified by bits.

Equal fingerprints are one node, so copies are never expanded. A posting list of more than CHUNK
fingerprints is dealt out in chunks and compared chunk by chunk in separate groups; a group returns
links that span what it found connected, not all its pairs. Nothing is dropped or capped.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shingles
from .common import components, mapped, sifted, spanning, stored

BITS = 3
CHUNK = 512
#: Shingles of the texts that a chunk of near_copies() holds, about.
HASHES = 2_000_000
#: Shingles of a text that are hashed at a time.
SLICE = 1 << 18


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> bytes:
    """8 bytes, most significant first; zero for a text without words."""
    low = (text or "").encode("utf-8", "surrogatepass").lower()
    flat = b" ".join(low.split())
    if not flat:
        return bytes(8)
    gaps = np.flatnonzero(np.frombuffer(flat, np.uint8) == 32)
    n = max(1, len(gaps) + 2 - width)
    begin = np.concatenate([[0], gaps + 1])[:n].tolist()
    end = np.concatenate([gaps, [len(flat)]])[min(width, len(gaps) + 1) - 1 :][:n].tolist()
    digest = xxhash.xxh64_digest
    counts = np.zeros(64, np.int64)
    for at in range(0, n, SLICE):
        hashes = b"".join([digest(flat[a:z], seed) for a, z in zip(begin[at : at + SLICE], end[at : at + SLICE], strict=True)])
        counts += np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int32)
    return np.packbits(counts * 2 > n).tobytes()


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3, seed: int = 42) -> DataFrame:
    """(key, fp): fp is the fingerprint as a signed long. Null texts are empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = b"".join([fingerprint(x.as_py(), width, seed) for x in batch.column(1)])
            fps = np.frombuffer(made, ">i8").astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], names=[key, "fp"])

    kind = docs.schema[key].dataType.simpleString()
    return mapped(docs.select(key, text), run, f"`{key}` {kind}, fp long")


TRIPLES = [*combinations(range(4), 3), *combinations(range(4, 8), 3)]


def _postings(nodes: DataFrame) -> DataFrame:
    """(posting, fp): the number of a triple above its three bytes."""
    byte = lambda i: F.shiftrightunsigned("fp", 56 - 8 * i).bitwiseAND(255)
    key = lambda t, at: F.lit(t << 24).cast("long") + byte(at[0]) * 65536 + byte(at[1]) * 256 + byte(at[2])
    return nodes.select("fp", F.explode(F.array(*[key(t, at) for t, at in enumerate(TRIPLES)])).alias("posting"))


def _linked(a: np.ndarray, b: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The places in a and b of pairs within that distance: tally of equal bytes first, then bits."""
    apart = a[:, None] ^ b[None, :]
    tally = (apart.view(np.uint8).reshape(*apart.shape, 8) == 0).sum(axis=2)
    i, j = np.nonzero(tally >= 8 - bits)
    near = np.bitwise_count(apart[i, j]) <= bits
    return i[near], j[near]


def _spanning_links(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (posting, i, j), own chunk c: links that span each group's components."""

    def links(c: np.ndarray, fp: np.ndarray, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        bare = fp.astype(np.uint64)
        if i == j:
            a, b = _linked(bare, bare, bits)
            root = spanning(len(fp), a, b)
            own = np.flatnonzero(root != np.arange(len(fp)))
            return fp[own], fp[root[own]]
        left, right = np.flatnonzero(c == i), np.flatnonzero(c == j)
        roots = []
        for side in (left, right):
            a, b = _linked(bare[side], bare[side], bits)
            roots.append(side[spanning(len(side), a, b)])
        a, b = _linked(bare[left], bare[right], bits)
        pairs = np.unique(np.stack([roots[0][a], roots[1][b]], axis=1), axis=0) if len(a) else np.zeros((0, 2), np.int64)
        if len(pairs) > len(fp):  # a tree of them says the same
            root = spanning(len(fp), pairs[:, 0], pairs[:, 1])
            own = np.flatnonzero(root != np.arange(len(fp)))
            return fp[own], fp[root[own]]
        return fp[pairs[:, 0]], fp[pairs[:, 1]]

    held: list[np.ndarray] = []
    rest = np.zeros((0, 5), np.int64)
    for batch in _with_end(batches):
        if batch is not None:
            rest = np.concatenate([rest, np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(5)], axis=1)])
        if not len(rest):
            continue
        change = np.flatnonzero((rest[1:, :3] != rest[:-1, :3]).any(axis=1)) + 1
        bounds = [0, *change.tolist(), *([len(rest)] if batch is None else [])]
        for lo, hi in zip(bounds, bounds[1:], strict=False):
            if hi - lo > 1:
                a, b = links(rest[lo:hi, 3], rest[lo:hi, 4], int(rest[lo, 1]), int(rest[lo, 2]))
                held.append(np.stack([a, b], axis=1))
        rest = rest[bounds[-1] :]
        if held:
            out = np.concatenate(held)
            held = []
            yield pa.RecordBatch.from_arrays([pa.array(out[:, 0]), pa.array(out[:, 1])], names=["a", "b"])


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def fingerprint_links(nodes: DataFrame, bits: int = BITS, chunk: int = CHUNK) -> DataFrame:
    """(a, b) over distinct fingerprints fp: links whose components are those of all pairs within bits (at most 3)."""
    if not 0 <= bits <= 3:
        raise ValueError("the index guarantees pairs up to 3 bits apart")
    postings = _postings(nodes)
    lists = postings.groupBy("posting").agg(F.count("*").alias("n")).where("n > 1")
    lists = lists.select("posting", F.ceil(F.col("n") / chunk).cast("int").alias("chunks"))
    rows = postings.join(lists, "posting").withColumn("c", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int"))
    rows = rows.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    rows = rows.select("posting", F.least("c", "o").alias("i"), F.greatest("c", "o").alias("j"), "c", "fp")
    rows = rows.repartition("posting", "i", "j").sortWithinPartitions("posting", "i", "j")
    return mapped(rows, lambda it: _spanning_links(it, bits), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per row of docs: key, fingerprint (16 hex digits), component_id.

    component_id is the smallest key reachable over links. Texts that are null, empty or blank have the
    fingerprint zero and link as any other. Repeated rows give repeated rows of the same component. A row
    whose key is null has the smallest key of its component, or null where it has none. Other columns are
    not read. An empty table gives an empty one.
    """
    prints = stored(fingerprints(docs, key, text), "fingerprints")
    nodes = stored(prints.groupBy("fp").agg(F.min(key).alias("least")), "nodes")
    found = components(fingerprint_links(nodes))
    whole = nodes.join(found, nodes.fp == found.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    least = whole.groupBy("component").agg(F.min("least").alias("component_id"))
    named = whole.join(least, "component").select("fp", "component_id")
    return prints.join(named, "fp").select(key, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", similar: float = shingles.SIMILAR, width: int = shingles.WORDS) -> DataFrame:
    """key, component_id: texts linked at a Jaccard similarity of their word shingles; component_id is the smallest key reachable.

    Fingerprints of such texts differ in about 10 of 64 bits, beyond what the byte index guarantees, so that it gives only
    some of the candidates here; min-wise bands give the others. Texts of equal words are one node. First each node is compared with
    nodes of its own fingerprint or within BITS of it, and in each band with the node whose bands are the most frequent. Then
    bands that hold more than one component are compared in chunks of bounded size, texts of different components only; what
    comes out are links between components, not pairs. Every similarity is computed on whole sets of shingles.

    A row per row of docs with a key; rows without one are left out. Null, empty and blank texts are one node without shingles, and
    link with nothing else. Repeated rows are of one node. Other columns are not read. An empty table gives an empty one.
    """
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"))
    marked = mapped(rows, lambda it: shingles.marks(it, width), f"key {kind}, node string, fp long, many long, bands array<long>")
    marked = stored(marked, "marked")
    nodes = marked.groupBy("node").agg(F.min("key").alias("least"), *[F.first(x).alias(x) for x in ("fp", "many", "bands")])
    nodes = stored(nodes, "nodes")

    postings = nodes.select("node", "many", F.explode("bands").alias("band"))
    lists = postings.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    # At most BANDS entries for each node.
    ranked = postings.join(lists, "band").groupBy("node", "many").agg(F.sort_array(F.collect_list(F.struct("n", "band"))).alias("ranked"))
    weight = F.aggregate("ranked", F.lit(0).cast("long"), lambda total, x: total + x["n"])
    few = F.slice("ranked", 1, F.greatest(F.size("ranked") - (shingles.SHARED - 1), F.lit(0)))
    postings = ranked.select("node", "many", weight.alias("weight"), F.explode(F.transform(few, lambda x: x["band"])).alias("band"))
    postings = stored(postings, "postings")
    hubs = postings.groupBy("band").agg(F.max(F.struct("weight", "node")).alias("hub"), F.count("*").alias("n")).where("n > 1")
    stars = postings.join(hubs.select("band", F.col("hub.node").alias("a")), "band").where("node <> a").select("a", F.col("node").alias("b"))
    prints = stored(nodes.where("many > 0").groupBy("fp").agg(F.min("node").alias("first")), "prints")
    same = nodes.join(prints, "fp").where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    near = fingerprint_links(prints.select("fp")).join(prints.select(F.col("fp").alias("a"), F.col("first").alias("x")), "a")
    near = near.join(prints.select(F.col("fp").alias("b"), F.col("first").alias("y")), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    stars = stored(stars.union(same).union(near).distinct(), "stars")

    used = stars.select(F.col("a").alias("node")).union(stars.select("b")).union(postings.select("node")).distinct()
    used = stored(nodes.join(used, "node", "left_semi").select("node", F.col("least").alias("key")), "used")
    sets = mapped(sifted(rows, used, "key")[0].join(used, "key").select("node", "text"), lambda it: shingles.sets_of(it, width), "node string, own array<long>")
    sets = stored(sets.dropDuplicates(["node"]), "sets")
    pairs = stars.join(sets.withColumnRenamed("node", "b").withColumnRenamed("own", "y"), "b")
    pairs = pairs.join(sets.withColumnRenamed("node", "a").withColumnRenamed("own", "x"), "a")
    both = F.size(F.array_intersect("x", "y"))
    found = components(stored(pairs.where(both / (F.size("x") + F.size("y") - both) >= similar).select("a", "b"), "links"))

    held = postings.join(found, "node", "left").select("band", "node", "many", F.coalesce("component", "node").alias("part"))
    held = stored(held, "held")
    names = [F.bit_xor(F.xxhash64(F.lit(n), "node")).alias(f"x{n}") for n in range(2)]
    chunks = F.ceil(F.greatest(F.count("*") / CHUNK, F.sum("many") / HASHES)).cast("int").alias("chunks")
    bands = held.groupBy("band").agg((F.min("part") < F.max("part")).alias("open"), chunks, F.count("*").alias("n"), *names).where("open")
    bands = bands.groupBy("n", "x0", "x1").agg(F.min("band").alias("band"), F.max("chunks").alias("chunks"))  # one of bands with the same nodes
    held = held.join(bands.select("band", "chunks"), "band").join(sets, "node")
    held = held.withColumn("c", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    held = held.select("band", F.least("c", "o").alias("i"), F.greatest("c", "o").alias("j"), "c", "part", "own")
    held = held.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j")
    more = stored(mapped(held, lambda it: shingles.across(it, similar), "a string, b string").distinct(), "more")
    again = components(more).select(F.col("node").alias("part"), F.col("component").alias("whole"))

    whole = nodes.join(found, "node", "left").select("node", "least", F.coalesce("component", "node").alias("part")).join(again, "part", "left")
    whole = stored(whole.select("node", "least", F.coalesce("whole", "part").alias("whole")), "whole")
    least = whole.groupBy("whole").agg(F.min("least").alias("component_id"))
    return marked.select("key", "node").join(whole.join(least, "whole").select("node", "component_id"), "node").select(F.col("key").alias(key), "component_id")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", similar: float | None = None) -> DataFrame:
    """The rows of docs, one of each component: that with the smallest key, once if it is repeated. Rows without a key stay.

    Components are those of near_duplicates(), or with similar those of near_copies() at that similarity."""
    marked = near_duplicates(docs, key, text) if similar is None else near_copies(docs, key, text, similar)
    marked = marked.where(F.col(key).isNotNull())
    kept = stored(marked.groupBy(key).agg(F.count_if(F.col(key) == F.col("component_id")).alias("rows")), "kept")
    gone = kept.where("rows = 0").select(key)
    may, stay = sifted(docs.where(F.col(key).isNotNull()), gone, key)
    out = stay.unionByName(may.join(gone, key, "left_anti").select(*docs.columns))
    if not kept.where("rows > 1").isEmpty():
        out = out.dropDuplicates([key])
    return out.unionByName(docs.where(F.col(key).isNull()))
