"""Layered navigable small-world graphs over short vectors, built and searched in lock step.

All queries of a block move at once: in each step every query expands its nearest unexpanded nodes,
and one gather, one distance computation and one partial sort serve the whole block. A layer is linked
from the neighbours of its nodes along the lexicographic order of the vectors, spread out so that
links point in different directions; the layer above, a sixteenth of the nodes, leads to the right
stretch. A graph that does not find what exhaustive search finds is linked again through the
neighbours of neighbours, and searched exhaustively if that does not help.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

LINKS, WINDOW = 16, 14
RATIO, TOP = 16, 64
EXPAND, BLOCK = 4, 2048
BEAMS = (16, 24, 32, 48, 64, 96, 128)
#: Nodes that a beam is tuned on, the neighbours wanted of each, and the part of them to be found.
SAMPLE, NEAREST, WANTED = 256, 5, 0.98
ROUNDS = 2


def _far(x: np.ndarray, q: np.ndarray, ids: np.ndarray) -> np.ndarray:
    diff = x[ids] - q[:, None, :]
    out = np.einsum("qkd,qkd->qk", diff, diff)
    out[ids < 0] = np.inf
    return out


def _distinct(ids: np.ndarray) -> np.ndarray:
    """Repeated ids within a row become -1."""
    order = np.argsort(ids, axis=1, kind="stable")
    row = np.take_along_axis(ids, order, 1)
    row[:, 1:][row[:, 1:] == row[:, :-1].copy()] = -1
    out = np.empty_like(row)
    np.put_along_axis(out, order, row, 1)
    return out


def beam_search(x: np.ndarray, links: np.ndarray, q: np.ndarray, start: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, squared distances) of up to `beam` nodes near each query, nearest first; -1 fills up."""
    ids = np.full((len(q), beam), -1, dtype=np.int64)
    far = np.full((len(q), beam), np.inf, dtype=np.float32)
    width = min(beam, start.shape[1])
    start = _distinct(start)
    d = _far(x, q, start)
    pick = np.argsort(d, axis=1)[:, :width]
    ids[:, :width], far[:, :width] = np.take_along_axis(start, pick, 1), np.take_along_axis(d, pick, 1)
    ids[~np.isfinite(far)] = -1
    done = ids < 0
    live = np.arange(len(q))
    while len(live):
        waiting = np.where(done[live], np.inf, far[live])
        e = min(EXPAND, beam)
        at = np.argpartition(waiting, e - 1, axis=1)[:, :e] if e < beam else np.broadcast_to(np.arange(beam), waiting.shape)
        open_ = np.isfinite(np.take_along_axis(waiting, at, 1))
        some = open_.any(axis=1)
        live, at, open_ = live[some], at[some], open_[some]
        if not len(live):
            break
        nodes = np.where(open_, np.take_along_axis(ids[live], at, 1), -1)
        state = done[live]
        np.put_along_axis(state, at, True, 1)
        done[live] = state
        near = np.where(nodes[:, :, None] >= 0, links[nodes], -1).reshape(len(live), -1)
        near = _distinct(near)
        known = (near[:, :, None] == ids[live][:, None, :]).any(axis=2)
        near[known] = -1
        d = _far(x, q[live], near)
        d[d >= far[live].max(axis=1, keepdims=True)] = np.inf
        all_d = np.concatenate([far[live], d], axis=1)
        best = np.argpartition(all_d, beam - 1, axis=1)[:, :beam]
        all_ids = np.concatenate([ids[live], near], axis=1)
        all_done = np.concatenate([done[live], np.zeros(near.shape, dtype=bool)], axis=1)
        far[live] = np.take_along_axis(all_d, best, 1)
        ids[live] = np.take_along_axis(all_ids, best, 1)
        done[live] = np.take_along_axis(all_done, best, 1) | ~np.isfinite(far[live])
    order = np.argsort(far, axis=1, kind="stable")
    ids, far = np.take_along_axis(ids, order, 1), np.take_along_axis(far, order, 1)
    ids[~np.isfinite(far)] = -1
    return ids, far


def exhaustive(x: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, squared distances) of the k nearest rows of x, in blocks of queries."""
    x = x.astype(np.float64)  # far coordinates would cancel in single precision
    k, own = min(k, len(x)), np.einsum("ij,ij->i", x, x)
    ids, far = np.empty((len(q), k), dtype=np.int64), np.empty((len(q), k))
    step = max(1, (1 << 24) // max(1, len(x)))
    for low in range(0, len(q), step):
        b = q[low : low + step].astype(np.float64)
        d = np.maximum(np.einsum("ij,ij->i", b, b)[:, None] + own[None] - 2 * b @ x.T, 0)
        at = np.argpartition(d, k - 1, axis=1)[:, :k]
        dist = np.take_along_axis(d, at, 1)
        order = np.argsort(dist, axis=1, kind="stable")
        ids[low : low + step], far[low : low + step] = np.take_along_axis(at, order, 1), np.take_along_axis(dist, order, 1)
    return ids, far


def _spread(x: np.ndarray, ids: np.ndarray, far: np.ndarray, most: int) -> np.ndarray:
    """Of the candidates (nearest first) those nearer to the node than to a chosen one, then the rest."""
    n, c = ids.shape
    chosen = np.full((n, most), -1, dtype=np.int64)
    count = np.zeros(n, dtype=np.int64)
    taken = ids < 0
    for j in range(c):
        r = np.flatnonzero((ids[:, j] >= 0) & (count < most))
        if not len(r):
            continue
        used = int(count.max())
        good = r
        if used:
            diff = x[chosen[r, :used]] - x[ids[r, j]][:, None, :]
            near = np.einsum("qkd,qkd->qk", diff, diff)
            near[chosen[r, :used] < 0] = np.inf
            good = r[(near > far[r, j][:, None]).all(axis=1)]
        chosen[good, count[good]] = ids[good, j]
        count[good] += 1
        taken[good, j] = True
    # what is left fills up, nearest first
    rank = count[:, None] + np.cumsum(~taken, axis=1) - 1
    row, col = np.nonzero(~taken & (rank < most))
    chosen[row, rank[row, col]] = ids[row, col]
    return chosen


@dataclass
class SmallWorld:
    """Nodes in a random order; layer l holds the first sizes[l] nodes, the last layer all of them."""

    x: np.ndarray
    order: np.ndarray
    layers: list[np.ndarray]
    beam: int = BEAMS[0]
    recall: float = 1.0
    #: Search looks at every node: the graph did not reach WANTED.
    whole: bool = False

    def search(self, q: np.ndarray, beam: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(node numbers as given to `build`, squared distances), nearest first."""
        if self.whole and beam is None:
            ids, far = exhaustive(self.x, q, self.beam)
            return self.order[ids], far
        beam = beam or self.beam
        found = [self._descend(q[low : low + BLOCK], beam) for low in range(0, len(q), BLOCK)]
        if not found:
            return np.empty((0, beam), np.int64), np.empty((0, beam), np.float32)
        ids, far = (np.concatenate(part) for part in zip(*found))
        return np.where(ids >= 0, self.order[ids], -1), far

    def _descend(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        top = self.x[: len(self.layers[0])]
        ids, far = exhaustive(top, q, 8 if len(self.layers) > 1 else beam)
        for layer in self.layers[1:]:
            ids, far = beam_search(self.x, layer, q, ids[:, :8], beam if layer is self.layers[-1] else 12)
        return ids, far


def _linked(x: np.ndarray, candidates) -> np.ndarray:
    """LINKS of every row of x; candidates(rows) gives ids to choose from, the two next in line first."""
    out = np.full((len(x), LINKS), -1, dtype=np.int64)
    for low in range(0, len(x), BLOCK):
        rows = np.arange(low, min(low + BLOCK, len(x)))
        line = candidates(rows)
        out[rows, :2] = line[:, :2]  # the line keeps the layer in one piece
        near = _distinct(np.where(line == rows[:, None], -1, line))
        far = _far(x, x[rows], near)
        pick = np.argsort(far, axis=1, kind="stable")[:, : 2 * LINKS]
        far, near = np.take_along_axis(far, pick, 1), np.take_along_axis(near, pick, 1)
        out[rows, 2:] = _spread(x, np.where(np.isfinite(far), near, -1), far, LINKS - 2)
    return out


def _layer(x: np.ndarray) -> np.ndarray:
    n = len(x)
    line = np.lexsort(x.T[::-1])
    place = np.empty(n, dtype=np.int64)
    place[line] = np.arange(n)
    steps = np.array([s * k for k in range(1, WINDOW + 1) for s in (-1, 1)])

    def along(rows: np.ndarray) -> np.ndarray:
        at = place[rows][:, None] + steps[None]
        return np.where((at >= 0) & (at < n), line[np.clip(at, 0, n - 1)], -1)

    return _linked(x, along)


def _relinked(x: np.ndarray, links: np.ndarray) -> np.ndarray:
    """Links chosen again from the neighbours and their neighbours."""

    def around(rows: np.ndarray) -> np.ndarray:
        own = links[rows]
        further = np.where(own[:, :, None] >= 0, links[own], -1).reshape(len(rows), -1)
        return np.concatenate([own, further], axis=1)

    return _linked(x, around)


def build(x: np.ndarray, seed: int = 0) -> SmallWorld:
    """Graph over the rows of x; its beam is the narrowest that finds what exhaustive search finds."""
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(x))
    x = np.ascontiguousarray(x[order], dtype=np.float32)
    sizes = [len(x)]
    while sizes[-1] > TOP:
        sizes.append(max(1, sizes[-1] // RATIO))
    graph = SmallWorld(x, order, [np.empty((sizes[-1], 0), dtype=np.int64)])
    graph.layers += [_layer(x[:size]) for size in sizes[-2::-1]]
    for _ in range(ROUNDS):
        if tune(graph, rng):
            return graph
        graph.layers[1:] = [_relinked(x[: len(layer)], layer) for layer in graph.layers[1:]]
    graph.whole = not tune(graph, rng)
    return graph


def tune(graph: SmallWorld, rng: np.random.Generator) -> bool:
    """Widen the beam until sampled nodes find themselves and their nearest; False if the widest does not.

    `recall` is the smaller of the two parts found. Equal vectors stand for one another.
    """
    n = len(graph.x)
    graph.beam = min(BEAMS[0], n)
    picked = rng.choice(n, min(SAMPLE, n), replace=False)
    q = graph.x[picked]
    _, far = exhaustive(graph.x, q, min(NEAREST, n))
    for beam in dict.fromkeys(min(b, n) for b in BEAMS):
        _, got = graph.search(q, beam)
        reached = got[:, : far.shape[1]] <= far * (1 + 1e-4) + 1e-3
        graph.beam, graph.recall = beam, float(min(reached.mean(), reached[:, 0].mean()))
        if graph.recall >= WANTED:
            return True
    return False
