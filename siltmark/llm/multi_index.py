"""Inverted multi-index over vectors: two half codebooks, cells of centroid pairs, bins of cells.

A vector's halves are quantised separately; the pair of centroids is its cell. A query visits cells
by the sum of its two squared distances, from a heap, until the visited cells hold TARGET different
directions: copies and near-copies of a vector, at whatever length, count as one. Cells that share the first centroid form a bin, and every vector is sent once to each bin it visits.

A hot bin (more than PART_ROWS entries by the sample) is cut into leaves by a codebook of its own over
whole vectors, and a query that comes to one of its cells visits the nearest leaves first, until
TARGET entries are held: a cell with a third of all rows does not cost the square of its rows. A leaf
that holds more than PART_ROWS entries is cut into parts of entries, one that more than QUERY_ROWS
vectors visit (by the visits of the sample) into chunks of queries, both by the hash of the vector, so
what a task sees stays bounded on either side.

Codebooks are fitted on SAMPLE_ROWS vectors at most; every vector is indexed.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from siltmark.session import table

DIMENSIONS = 384
SAMPLE_ROWS = 16384
#: Different directions (see `directions`) that the visited cells of a query hold, at least.
TARGET = 8192
#: Codebooks grow with the root of the number of vectors: about N / CELL_ROWS cells.
CELL_ROWS = 200
MOST_CENTROIDS = 1024
PART_ROWS = 32768
#: Queries that a task answers, about, and vectors of the sample whose visits are counted per such task.
QUERY_ROWS, VISITS = 16384, 16
LEAST_VISITORS = 1024
#: Entries of a leaf of a hot bin, about; a leaf is fitted on at least LEAF_SAMPLE vectors.
LEAF_ROWS = 4096
LEAF_SAMPLE = 4
#: The last part of what a query visits: one of FRONTIER.
FRONTIER = 4
#: Of equal vectors at most this many ids, the smallest, are kept as entries of a part.
SAME = 6

SENT = "bin int, leaf int, part int, chunk int, entry boolean, asks boolean, cells array<int>, ids array<long>, payload binary"
_SENT_ARROW = pa.schema([*((c, pa.int32()) for c in ("bin", "leaf", "part", "chunk")), ("entry", pa.bool_()), ("asks", pa.bool_()), ("cells", pa.list_(pa.int32())), ("ids", pa.list_(pa.int64())), ("payload", pa.binary())])
TASK = ("bin", "leaf", "part", "chunk")


def usable_rows(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(ids, vectors) of the usable rows of a batch with vec_id and emb.

    Usable: DIMENSIONS numbers, no null, NaN or infinity, not all zero. Rows with a payload (see `encode`) are usable.
    """
    if "payload" in batch.schema.names:
        return np.asarray(batch.column("vec_id"), dtype=np.int64), decode(batch.column("payload").to_pylist())
    ids, emb = batch.column("vec_id"), batch.column("emb")
    lengths = np.asarray(emb.value_lengths().fill_null(-1))
    right = np.flatnonzero((lengths == DIMENSIONS) & ~np.asarray(ids.is_null()))
    if not len(right):
        return np.empty(0, np.int64), np.empty((0, DIMENSIONS), np.float32)
    flat = emb.take(pa.array(right)).flatten()
    x = np.asarray(flat.fill_null(np.nan), dtype=np.float32).reshape(-1, DIMENSIONS)
    fine = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
    return np.asarray(ids.take(pa.array(right[fine])), dtype=np.int64), x[fine]


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # keeps tiny and huge lengths in range
    return (x / np.sqrt(np.einsum("ij,ij->i", x, x, dtype=np.float64))[:, None]).astype(np.float32)


def directions(u: np.ndarray) -> list[int]:
    """A digest of each unit vector to three decimals: vectors that differ in length only share it, but for rounding."""
    return [xxhash.xxh64_intdigest(r.tobytes()) - (1 << 63) for r in np.round(u * 1000).astype(np.int16)]


def encode(x: np.ndarray) -> list[bytes]:
    """Each vector as bytes: 16-bit floats where they lose nothing, else 32-bit ones."""
    with np.errstate(over="ignore"):
        half = x.astype(np.float16)
    exact = (half.astype(np.float32) == x).all(axis=1)
    return [half[i].tobytes() if exact[i] else x[i].tobytes() for i in range(len(x))]


def decode(payloads) -> np.ndarray:
    out = np.empty((len(payloads), DIMENSIONS), dtype=np.float32)
    for i, p in enumerate(payloads):
        out[i] = np.frombuffer(p, dtype=np.float16 if len(p) == 2 * DIMENSIONS else np.float32)
    return out


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 0) -> np.ndarray:
    """Centroids of at most k clusters; spread starts, empty clusters restart at far points."""
    rng = np.random.default_rng(seed)
    k = min(k, len(x))
    norm = np.einsum("ij,ij->i", x, x)
    start = [int(rng.integers(len(x)))]
    far = norm + norm[start[0]] - 2 * x @ x[start[0]]
    while len(start) < k:
        weight = np.maximum(far, 0)
        total = weight.sum()
        pick = int(rng.choice(len(x), p=weight / total)) if total > 0 else int(rng.integers(len(x)))
        start.append(pick)
        far = np.minimum(far, norm + norm[pick] - 2 * x @ x[pick])
    c = x[start].astype(np.float32)
    for _ in range(rounds):
        d = np.einsum("ij,ij->i", c, c)[None] - 2 * x @ c.T
        at = d.argmin(axis=1)
        count = np.bincount(at, minlength=k)
        order = np.argsort(at, kind="stable")
        used = np.flatnonzero(count)
        sums = np.add.reduceat(x[order], np.r_[0, np.cumsum(count[used])[:-1]], axis=0)
        c[used] = sums / count[used, None]
        if len(used) < k:
            worst = np.argsort(-(d.min(axis=1) + norm))[: k - len(used)]
            c[np.setdiff1d(np.arange(k), used)] = x[worst]
    return c


@dataclass
class MultiIndex:
    """Half codebooks, leaf codebooks of hot bins, and per cell (first, second, leaf) the directions it holds.

    Cells are packed numbers in order, with a count each: at most MOST_CENTROIDS ** 2 cells and, in hot
    bins, MOST_CENTROIDS times SAMPLE_ROWS / LEAF_SAMPLE more. `parts` and `chunks` have an entry per bin or leaf.
    """

    first: np.ndarray
    second: np.ndarray
    leaves: dict[int, np.ndarray]
    cells: np.ndarray
    held: np.ndarray
    parts: dict[tuple[int, int], int]
    chunks: dict[tuple[int, int], int]

    def __post_init__(self) -> None:
        self.filled = set(np.unique(self.cells >> 40).tolist())
        self.opened: dict[int, tuple[np.ndarray, dict[tuple[int, int], int]]] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"opened": {}}

    def bin_of(self, a: int) -> tuple[np.ndarray, dict[tuple[int, int], int]]:
        """Second centroids of a bin, and the directions of its (second, leaf); looked up once per process."""
        if a not in self.opened:
            low, high = np.searchsorted(self.cells, [a << 40, (a + 1) << 40])
            b, leaf = self.cells[low:high] >> 20 & 0xFFFFF, self.cells[low:high] & 0xFFFFF
            self.opened[a] = np.unique(b), dict(zip(zip(b.tolist(), leaf.tolist()), self.held[low:high].tolist()))
        return self.opened[a]

    def leaf_of(self, x: np.ndarray, bins: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), dtype=np.int64)
        for a, c in self.leaves.items():
            own = np.flatnonzero(bins == a)
            if len(own):
                out[own] = (np.einsum("ij,ij->i", c, c)[None] - 2 * x[own] @ c.T).argmin(axis=1)
        return out

    def distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = DIMENSIONS // 2
        one = [np.einsum("ij,ij->i", p, p)[:, None] + np.einsum("ij,ij->i", c, c)[None] - 2 * p @ c.T for p, c in ((x[:, :h], self.first), (x[:, h:], self.second))]
        return np.maximum(one[0], 0), np.maximum(one[1], 0)

    def visited(self, x: np.ndarray, d1: np.ndarray, d2: np.ndarray, target: int, mark: bool = False) -> dict[tuple[int, int], list[int]]:
        """Cells by summed distance until they hold `target` directions: (first centroid, leaf) -> second ones.

        With `mark` the cells that reach into the FRONTIER, the last directions visited, come as ~second.
        """
        frontier = target - target // FRONTIER if mark else math.inf
        order = [a for a in np.argsort(d1, kind="stable").tolist() if a in self.filled]
        least = float(d2.min())
        heap: list[tuple[float, int, int]] = []
        rows: dict[int, list[int]] = {}
        nearest: dict[int, list[int]] = {}
        out: dict[tuple[int, int], list[int]] = {}
        opened, held = 0, 0
        while held < target:
            while opened < len(order) and (not heap or d1[order[opened]] + least <= heap[0][0]):
                a = order[opened]
                bs = self.bin_of(a)[0]
                rows[a] = bs[np.argsort(d2[bs], kind="stable")].tolist() if len(bs) > 1 else [int(bs[0])]
                heapq.heappush(heap, (float(d1[a] + d2[rows[a][0]]), a, 0))
                opened += 1
            if not heap:
                break
            _, a, i = heapq.heappop(heap)
            b = rows[a][i]
            if a in self.leaves and a not in nearest:
                c = self.leaves[a]
                nearest[a] = np.argsort(np.einsum("ij,ij->i", c, c) - 2 * c @ x, kind="stable").tolist()
            for leaf in nearest.get(a, (0,)):
                if held < target and (n := self.bin_of(a)[1].get((b, leaf))):
                    out.setdefault((a, leaf), []).append(b if held + n <= frontier else ~b)
                    held += n
            if i + 1 < len(rows[a]):
                heapq.heappush(heap, (float(d1[a] + d2[rows[a][i + 1]]), a, i + 1))
        return out


def reader(change: Callable[[np.ndarray, np.ndarray], pa.RecordBatch | None]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, x = usable_rows(batch)
            if len(ids) and (out := change(ids, x)) is not None:
                yield out

    return run


def build_index(spark: SparkSession, vectors: DataFrame, target: int | None = None) -> MultiIndex:
    """Codebooks from a bounded sample in hash order, cell sizes from all usable vectors, visits from the sample.

    An index over no usable vectors has no cells.
    """
    target = TARGET if target is None else target
    rows = vectors.count()
    threshold = min(1 << 30, int((1 << 30) * SAMPLE_ROWS / max(rows, 1)))
    sampled = vectors.where(F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(1 << 30)) < threshold)
    packed = sampled.mapInArrow(reader(lambda ids, x: pa.record_batch({"payload": pa.array(encode(x), pa.binary())})), "payload binary").collect()
    sample = unit(decode([r.payload for r in packed])) if packed else np.empty((0, DIMENSIONS), np.float32)
    if not len(sample):
        sample = np.zeros((1, DIMENSIONS), np.float32)
    k = 1 << min(int(math.log2(MOST_CENTROIDS)), max(0, round(math.log2(math.sqrt(max(rows, 1) / CELL_ROWS)))))
    h = DIMENSIONS // 2
    first, second = kmeans(sample[:, :h], k, seed=1), kmeans(sample[:, h:], k, seed=2)
    none = np.empty(0, dtype=np.int64)
    bare = MultiIndex(first, second, {}, none, none, {}, {})
    home = bare.distances(sample)[0].argmin(axis=1)
    for a, n in enumerate(np.bincount(home, minlength=k).tolist()):
        share = n / len(sample) * rows
        m = min(math.ceil(share / LEAF_ROWS), n // LEAF_SAMPLE)
        if share > PART_ROWS and m > 1:
            bare.leaves[a] = kmeans(sample[home == a], m, seed=3)
    books = spark.sparkContext.broadcast(bare)  # at most 2 x MOST_CENTROIDS half vectors and SAMPLE_ROWS / LEAF_SAMPLE leaves

    def count(ids: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
        index, u = books.value, unit(x)
        d1, d2 = index.distances(u)
        a = d1.argmin(axis=1)
        cell = (a << 40) + (d2.argmin(axis=1) << 20) + index.leaf_of(u, a)
        vector = [xxhash.xxh64_intdigest(p) - (1 << 63) for p in encode(x)]
        found = sorted(set(zip(cell.tolist(), directions(u), vector)))
        return pa.record_batch([pa.array(c, pa.int64()) for c in zip(*found)], names=["cell", "direction", "vector"])

    # equal vectors, wherever they are read, become one row before anything is counted
    different = vectors.mapInArrow(reader(count), "cell long, direction long, vector long").distinct()
    counted = different.groupBy("cell", "direction").agg(F.count(F.lit(1)).alias("n")).groupBy("cell").agg(F.count(F.lit(1)).alias("directions"), F.sum("n").alias("n"))
    cells = counted.toArrow()  # three numbers per cell, see MultiIndex
    books.unpersist()
    cell, held, entries = (np.asarray(cells.column(c), dtype=np.int64) for c in ("cell", "directions", "n"))
    order = np.argsort(cell)
    cell, held, entries = cell[order], held[order], entries[order]
    of, at = np.unique((cell >> 40 << 20) + (cell & 0xFFFFF), return_inverse=True)
    names = [(o >> 20, o & 0xFFFFF) for o in of.tolist()]
    whole = np.bincount(at, entries, len(of)) if len(of) else none
    index = MultiIndex(first, second, bare.leaves, cell, held, {key: math.ceil(n / PART_ROWS) for key, n in zip(names, whole.tolist())}, {})
    index.chunks = chunks_of(spark, vectors, rows, index, target)
    return index


def chunks_of(spark: SparkSession, asking: DataFrame, rows: int, index: MultiIndex, target: int) -> dict[tuple[int, int], int]:
    """Chunks that `asking` vectors, about `rows`, need in every bin or leaf, from the visits of some of them."""
    shared = spark.sparkContext.broadcast(index)

    def visit(ids: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
        index, u = shared.value, unit(x)
        d1, d2 = index.distances(u)
        visits = [key for r in range(len(u)) for key in index.visited(u[r], d1[r], d2[r], target)]
        return pa.record_batch([pa.array(c, pa.int32()) for c in zip(*visits)], names=["bin", "leaf"])

    wanted = min(rows, SAMPLE_ROWS, max(LEAST_VISITORS, VISITS * rows // QUERY_ROWS))
    visitors = asking.where(F.pmod(F.xxhash64("vec_id", F.lit(2)), F.lit(1 << 30)) < int((1 << 30) * wanted / max(rows, 1)))
    visits = visitors.mapInArrow(reader(visit), "bin int, leaf int").groupBy("bin", "leaf").agg(F.count(F.lit(1)).alias("n")).collect()  # a row per bin or leaf
    shared.unpersist()
    return {(r.bin, r.leaf): math.ceil(r.n * rows / wanted / QUERY_ROWS) for r in visits}


def send(spark: SparkSession, vectors: DataFrame, index: MultiIndex, target: int, roles: tuple[str, ...] = ("entry", "asks"), mark: bool = False) -> DataFrame:
    """One row per vector and task that needs it (schema SENT); equal vectors of a batch travel as one row.

    `roles`: vectors go where they are entries, where they ask, or both; `mark`: see `visited`.

    A task is named by the TASK columns. `cells` are the second centroids visited in the bin, the home
    cell first; `entry` marks the tasks that the vector is an entry of, `asks` those it is a query of.
    """
    shared = spark.sparkContext.broadcast(index)

    def route(ids: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
        index = shared.value
        payload = encode(x)
        groups: dict[bytes, list[int]] = {}
        for i, p in enumerate(payload):
            groups.setdefault(p, []).append(i)
        u = unit(x[np.array([g[0] for g in groups.values()])])
        d1, d2 = index.distances(u)
        home1, home2 = d1.argmin(axis=1), d2.argmin(axis=1)
        leaves = index.leaf_of(u, home1)
        columns: list[list] = [[] for _ in _SENT_ARROW.names]
        for r, (data, members) in enumerate(groups.items()):
            key = xxhash.xxh64_intdigest(data)
            own = sorted(ids[members].tolist())
            home, b = (int(home1[r]), int(leaves[r])), int(home2[r])
            visits = index.visited(u[r], d1[r], d2[r], target, mark) if "asks" in roles else {}
            if "entry" in roles or home in visits:
                visits[home] = [b, *(c for c in visits.get(home, ()) if c != b)]
            for (bin_, leaf), cells in visits.items():
                parts, chunks = index.parts[bin_, leaf], index.chunks.get((bin_, leaf), 1)
                part, chunk = key % parts, (key >> 32) % chunks
                # queries meet all parts in one chunk, entries meet all chunks in one part
                entry = "entry" in roles and (bin_, leaf) == home
                needed = {(p, chunk) for p in range(parts)} if "asks" in roles else set()
                needed |= {(part, c) for c in range(chunks)} if entry else set()
                for p, c in sorted(needed):
                    for column, value in zip(columns, (bin_, leaf, p, c, entry and p == part, "asks" in roles and c == chunk, cells, own, data)):
                        column.append(value)
        return pa.record_batch([pa.array(c, t) for c, t in zip(columns, _SENT_ARROW.types)], schema=_SENT_ARROW)

    return vectors.mapInArrow(reader(route), SENT)


@dataclass
class Part:
    """What one task holds: distinct vectors (as stored, and at length 1), the ids of each, which are entries or ask, and their cells."""

    stored: np.ndarray
    x: np.ndarray
    ids: list[list[int]]
    entry: np.ndarray
    asks: np.ndarray
    cells: list[list[int]]

    def exact(self, rows: np.ndarray) -> np.ndarray:
        """Unit vectors of some rows, in double precision from what is stored."""
        x = self.stored[rows].astype(np.float64)
        x /= np.abs(x).max(axis=-1, keepdims=True)
        return x / np.sqrt((x * x).sum(axis=-1, keepdims=True))


def gather(group: pa.Table) -> Part:
    """Rows of one task with equal vectors merged."""
    columns = [group.column(c).to_pylist() for c in ("entry", "asks", "cells", "ids", "payload")]
    at: dict[bytes, int] = {}
    kept: list[list] = [[], [], [], []]
    for entry, asks, cells, ids, payload in zip(*columns):
        if payload in at:
            kept[3][at[payload]] = sorted({*kept[3][at[payload]], *ids})
        else:
            at[payload] = len(at)
            for column, value in zip(kept, (entry, asks, cells, ids)):
                column.append(value)
    stored = decode(list(at))
    return Part(stored, unit(stored), kept[3], np.array(kept[0], dtype=bool), np.array(kept[1], dtype=bool), kept[2])


def vectors_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "emb_cache").select("vec_id", "emb")
