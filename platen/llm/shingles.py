"""Word shingles as 64-bit hashes: sets, SimHash fingerprints, min-wise bands, and exact Jaccard similarity in blocks.

A band is the hash of ROWS least values under as many hash functions. Two texts at a similarity of 0.8 share SHARED of
their BANDS or more, but for one pair in 80,000. So the SHARED - 1 most frequent of a text's bands can go, by one order
of all bands: a pair that shares SHARED bands still meets in the rarest of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

from .common import Words, blocks, gather, spanning

WORDS, SIMILAR, BANDS, ROWS, SHARED = 5, 0.8, 32, 4, 3
#: Bytes of text that are hashed at a time.
BLOCK = 4 << 20
#: Shingles whose columns stand in a matrix at a time.
COLUMNS = 8192
_MADE = np.random.default_rng(42).integers(1, 2**63, (2, BANDS * ROWS), np.uint64)
FACTOR, SHIFT = _MADE[0] * np.uint64(2) + np.uint64(1), _MADE[1]
STEP = np.uint64(0x9E3779B97F4A7C15)


def bare(text: str | None) -> bytes:
    """The text's words in lower case (ASCII), one space between them."""
    return b" ".join((text or "").encode("utf-8", "surrogatepass").lower().split())


def name(text: str | None) -> str:
    """Equal for texts of equal words."""
    return hashlib.md5(bare(text)).hexdigest()


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def _run(word: np.ndarray, width: int) -> np.ndarray:
    """At each place the hash of the width words that begin there."""
    n = max(0, len(word) - width + 1)
    total = word[:n].copy()
    for k in range(1, width):
        total = total * STEP + word[k : k + n]
    return total


class Shingles:
    """hashes: of the shingles of a block's texts, one text after the other; sizes: how many each text has.

    A shingle is a run of width words in lower case; all words of a shorter text are one, and a text without words has none.
    """

    def __init__(self, texts: pa.Array, width: int = WORDS) -> None:
        seen = Words(texts, lower=True)
        raw = seen.words.cast(pa.binary()).to_pylist() if len(seen.words) else []
        word = np.fromiter(map(xxhash.xxh3_64_intdigest, raw), np.uint64, len(raw))[seen.word]
        self.sizes = np.where(seen.sizes < width, np.minimum(seen.sizes, 1), seen.sizes - width + 1)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)]).astype(np.int64)
        made = np.empty(self.starts[-1], np.uint64)
        for n in range(1, width + 1):
            own = np.flatnonzero(seen.sizes >= width if n == width else seen.sizes == n)
            if len(own):
                made[gather(self.starts[own], self.sizes[own])] = _run(word, n)[gather(seen.starts[own], self.sizes[own])]
        self.hashes = mixed(made)

    def sets(self) -> pa.ListArray:
        """The distinct hashes of each text."""
        doc = np.repeat(np.arange(len(self.sizes)), self.sizes)
        order = np.lexsort((self.hashes, doc))
        doc, own = doc[order], self.hashes[order]
        first = np.ones(len(own), bool)
        first[1:] = (doc[1:] != doc[:-1]) | (own[1:] != own[:-1])
        ends = np.concatenate([[0], np.cumsum(np.bincount(doc[first], minlength=len(self.sizes)))])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(own[first].astype(np.int64)))

    def bands(self) -> pa.ListArray:
        """BANDS keys for each text that has shingles, none for others."""
        some = np.flatnonzero(self.sizes > 0)
        least = np.empty((len(some), BANDS * ROWS), np.uint64)
        if len(some):
            for k in range(BANDS * ROWS):
                value = self.hashes * FACTOR[k] + SHIFT[k]
                value ^= value >> np.uint64(32)
                least[:, k] = np.minimum.reduceat(value, self.starts[some])
        rows = least.reshape(-1, BANDS, ROWS)
        key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), rows.shape[:2])
        for k in range(ROWS):
            key = key * STEP + rows[:, :, k]
        ends = np.concatenate([[0], np.cumsum((self.sizes > 0) * BANDS)])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(mixed(key).ravel().astype(np.int64)))

    def prints(self) -> np.ndarray:
        """SimHash: a bit is 1 if it is set in more than half of a text's shingles; 0 for a text without any."""
        out = np.zeros(len(self.sizes), np.uint64)
        some = np.flatnonzero(self.sizes > 0)
        if len(some):
            for b in range(64):
                count = np.add.reduceat((self.hashes >> np.uint64(b)) & np.uint64(1), self.starts[some])
                out[some] |= (2 * count > self.sizes[some]).astype(np.uint64) << np.uint64(b)
        return out.astype(np.int64)


def marks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """key, text -> key, node (equal for equal words), fp, many (shingles), bands."""
    for block in blocks(batches, 1, BLOCK):
        made = Shingles(block.column(1), width)
        node = pa.array([name(x.as_py()) for x in block.column(1)], pa.string())
        columns = [block.column(0), node, pa.array(made.prints()), pa.array(made.sizes.astype(np.int64)), made.bands()]
        yield pa.RecordBatch.from_arrays(columns, names=["key", "node", "fp", "many", "bands"])


def sets_of(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """node, text -> node, own (its distinct hashes), where the text has that name."""
    for block in blocks(batches, 1, BLOCK):
        same = pa.array([k == name(x.as_py()) for k, x in zip(block.column(0).to_pylist(), block.column(1), strict=True)], pa.bool_())
        block = block.filter(same)
        yield pa.RecordBatch.from_arrays([block.column(0), Shingles(block.column(1), width).sets()], names=["node", "own"])


def similarity(flat: np.ndarray, sizes: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Jaccard similarity of each of left to each of right, by number; flat: sets of these sizes, one after the other."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    _, code, times = np.unique(flat, return_inverse=True, return_counts=True)
    often = times[code] > 1
    owner, code = owner[often], code[often]
    column = np.cumsum(times > 1)[code] - 1
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    both = np.zeros((len(left), len(right)), np.float32)
    width = int(column[-1]) + 1 if len(column) else 0
    for at in range(0, width, COLUMNS):
        a, z = np.searchsorted(column, [at, at + COLUMNS])
        grid = np.zeros((len(sizes), min(COLUMNS, width - at)), np.float32)
        grid[owner[a:z], column[a:z] - at] = 1
        both += grid[left] @ grid[right].T
    both = both.astype(np.float64)
    return both / np.maximum(sizes[left][:, None] + sizes[right][None, :] - both, 1)


def across(batches: Iterator[pa.RecordBatch], similar: float) -> Iterator[pa.RecordBatch]:
    """Rows (band, i, j, c, part, own) sorted by the first three: links (a, b) that span the parts that similar texts join.

    c is a row's chunk, which is i or j; part the component that its text is in so far. Each group of rows is compared chunk
    i with chunk j, exactly; only texts of different parts matter.
    """

    def links(rows: pa.Table) -> tuple[list, list]:
        parts, part = np.unique(rows.column("part").to_numpy(), return_inverse=True)
        own = rows.column("own").combine_chunks()
        sizes = np.diff(own.offsets.to_numpy())
        flat = own.flatten().to_numpy()
        c = rows.column("c").to_numpy()
        i, j = rows.column("i")[0].as_py(), rows.column("j")[0].as_py()
        left, right = np.flatnonzero(c == i), np.flatnonzero(c == j)
        near = similarity(flat, sizes, left, right) >= similar
        x, y = np.nonzero(near & (part[left][:, None] != part[right][None, :]))
        root = spanning(len(parts), part[left][x], part[right][y])
        moved = np.flatnonzero(root != np.arange(len(parts)))
        return parts[moved].tolist(), parts[root[moved]].tolist()

    rest: pa.Table | None = None
    for batch in _and_end(batches):
        if batch is not None:
            more = pa.Table.from_batches([batch])
            rest = more if rest is None else pa.concat_tables([rest, more])
        if rest is None or not rest.num_rows:
            continue
        names = [rest.column(k).to_numpy() for k in ("band", "i", "j")]
        change = np.flatnonzero(np.any([x[1:] != x[:-1] for x in names], axis=0)) + 1
        bounds = [0, *change.tolist(), *([rest.num_rows] if batch is None else [])]
        a: list = []
        b: list = []
        for lo, hi in zip(bounds, bounds[1:], strict=False):
            if hi - lo > 1:
                one, other = links(rest.slice(lo, hi - lo))
                a += one
                b += other
        rest = rest.slice(bounds[-1])
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.string())], names=["a", "b"])


def _and_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None
