"""Packing of token sequences by Karmarkar-Karp differencing over many windows.

A document's ids are cut into full windows and a rest; rests are cut into near-equal pieces of at most
PIECE ids. Each run of documents of about GROUP windows is packed by itself, where it is read: partial
partitions, first one for each piece, are merged two at a time, those of the largest imbalance first, the
fuller windows of one onto the emptier ones of the other. Where a window would exceed the capacity, the
group gets one window more. No shuffle; a task holds one group.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import WordRanks
from .common import blocks, mapped

CAPACITY = 4096
PIECE = 1024
GROUP = 128
#: Bytes of text that are encoded at a time.
BLOCK = 3 << 20


def difference(sizes: list[int], k: int) -> list[list[int]]:
    """The numbers of the items in each of k windows, by differencing; windows may stay empty."""
    trees: list[tuple[int, int] | int] = list(range(len(sizes)))
    # A partial partition: its windows that hold something, fullest first, as (sum, tree).
    heap = [(-size, n, [(size, n)]) for n, size in enumerate(sizes)]
    heapq.heapify(heap)
    names = len(sizes)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        over = len(a) + len(b) - k
        if over > 0:
            lone_a, lone_b = a[: len(a) - over], b[: len(b) - over]
            both = []
            for (x, s), (y, t) in zip(a[len(a) - over :], reversed(b[len(b) - over :]), strict=True):
                trees.append((s, t))
                both.append((x + y, len(trees) - 1))
            merged = lone_a + lone_b + both
        else:
            merged = a + b
        merged.sort(reverse=True)
        spread = merged[0][0] - (merged[-1][0] if len(merged) == k else 0)
        heapq.heappush(heap, (-spread, names, merged))
        names += 1
    out = []
    for _, tree in heap[0][2] if heap else []:
        found, stack = [], [tree]
        while stack:
            node = trees[stack.pop()]
            if isinstance(node, tuple):
                stack += node
            else:
                found.append(node)
        out.append(sorted(found))
    return out


def pack_group(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Windows of at most capacity, each item of at most that: as few as the total needs, more while one is too full."""
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        windows = difference(sizes, k)
        if all(sum(sizes[n] for n in w) <= capacity for w in windows):
            return windows
        k += 1


def pieces(n: int, capacity: int = CAPACITY, piece: int = PIECE) -> list[tuple[int, int]]:
    """(start, length): full windows, then the rest in near-equal pieces."""
    full = [(at, capacity) for at in range(0, n - n % capacity, capacity)]
    rest = n % capacity
    parts = -(-rest // piece)
    bounds = [n - rest + rest * i // parts for i in range(parts + 1)] if parts else []
    return full + [(a, z - a) for a, z in zip(bounds, bounds[1:], strict=False)]


def pack(docs: DataFrame, tokenizer: str, end: int, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """A row per piece: key, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    A document's ids are those of its text, then end; a null or empty text has end alone. tokenizer is the path
    of a tokenizer.json on the driver. Each id lies in one piece; a sequence's pieces follow each other from
    offset 0 up to capacity. Repeated rows and rows without a key are packed as any other; other columns are
    not read; an empty table gives an empty one.
    """
    with open(tokenizer, "rb") as file:
        shared = docs.sparkSession.sparkContext.broadcast(file.read())
    kind = docs.schema[key].dataType.simpleString()
    columns = [key, "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = WordRanks(shared.value)
        number = TaskContext.get().partitionId() << 33
        held: list[tuple] = []
        total = 0

        def flush() -> pa.RecordBatch:
            nonlocal number
            full = [[n] for n, x in enumerate(held) if x[2] == capacity]
            rest = [n for n, x in enumerate(held) if x[2] < capacity]
            windows = full + [[rest[n] for n in w] for w in pack_group([held[n][2] for n in rest], capacity) if w]
            rows = []
            for w in windows:
                offset = 0
                for n in w:
                    rows.append((*held[n], number, offset))
                    offset += held[n][2]
                number += 1
            made = zip(*rows, strict=True)
            kinds = [keys, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(made, kinds, strict=True)], names=columns)

        for block in blocks(batches, 1, BLOCK):
            keys = block.column(0).type
            ids, sizes = own.texts(block.column(1))
            ids = ids.astype("<u4")
            ends = np.concatenate([[0], np.cumsum(sizes)]).tolist()
            last = np.array([end], "<u4").tobytes()
            for name, a, z in zip(block.column(0).to_pylist(), ends, ends[1:], strict=False):
                whole = ids[a:z].tobytes() + last
                n = z - a + 1
                for start, length in pieces(n, capacity):
                    held.append((name, start, length, whole[4 * start : 4 * (start + length)], n))
                    total += length * (length < capacity)
                if total >= GROUP * capacity or len(held) > 8 * GROUP:
                    yield flush()
                    held, total = [], 0
        if held:
            yield flush()

    schema = f"`{key}` {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    return mapped(docs.select(key, text), run, schema)


def digests(packed: DataFrame, key: str = "doc_id") -> DataFrame:
    return packed.select(key, "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
