"""A robust-pruned directed graph over the vectors of one shard, built and searched in batches of points.

Vectors have length one, nearness is the inner product.  Points enter in random order: a greedy search over the graph so far
proposes neighbours, the nearest is taken and removes every proposal that is nearer to it than to the point by more than a factor
(``relax``), and so on; what is left are few, diverse edges.  Edges back are added and pruned the same way when a node has too many.
"""

from __future__ import annotations

import numpy as np

DEGREE = 32
BEAM = 64
RELAX = 1.2
EXPANDED = 4
CELLS = 1 << 26


class Graph:
    def __init__(self, vectors: np.ndarray, edges: np.ndarray, start: int) -> None:
        self.vectors, self.edges, self.start = vectors, edges, start

    def search(self, queries: np.ndarray, beam: int = BEAM) -> np.ndarray:
        """For every query the ``beam`` nearest nodes a beam search meets, nearest first; -1 where there are fewer."""
        n = len(self.vectors)
        beam = min(beam, n)
        at_once = max(1, min(512, CELLS // n))
        parts = [self._search(queries[i : i + at_once], beam)[0] for i in range(0, len(queries), at_once)]
        return np.concatenate(parts) if parts else np.zeros((0, beam), dtype=np.int64)

    def _search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        rows = np.arange(len(queries))
        ids = np.full((len(queries), beam), -1, dtype=np.int64)
        near = np.full((len(queries), beam), -np.inf, dtype=np.float32)
        open_ = np.zeros((len(queries), beam), dtype=bool)
        seen = np.zeros((len(queries), len(self.vectors)), dtype=bool)
        ids[:, 0], near[:, 0], open_[:, 0] = self.start, queries @ self.vectors[self.start], True
        seen[:, self.start] = True
        while True:
            rows = rows[open_[rows].any(axis=1)]
            if not len(rows):
                return ids, near
            some = rows[:, None]
            order = np.cumsum(open_[rows], axis=1)
            pick = open_[rows] & (order <= EXPANDED)
            # positions of the picked entries, padded with -1
            slot = np.full((len(rows), EXPANDED), -1)
            r, c = np.nonzero(pick)
            slot[r, order[r, c] - 1] = c
            nodes = np.where(slot >= 0, ids[some, slot], -1)
            open_[rows[r], c] = False
            found = np.where(nodes[:, :, None] >= 0, self.edges[nodes], -1).reshape(len(rows), -1)
            fresh = (found >= 0) & ~seen[some, found]
            r, c = np.nonzero(fresh)
            target = found[r, c]
            seen[rows[r], target] = True
            # a node that two expanded nodes lead to is met twice: keep the first
            _, once = np.unique(r * len(self.vectors) + target, return_index=True)
            r, c, target = r[once], c[once], target[once]
            score = np.full(found.shape, -np.inf, dtype=np.float32)
            score[r, c] = np.einsum("ij,ij->i", self.vectors[target], queries[rows[r]])
            all_near = np.concatenate((near[rows], score), axis=1)
            best = np.argpartition(-all_near, beam - 1, axis=1)[:, :beam]
            best = np.take_along_axis(best, np.argsort(-np.take_along_axis(all_near, best, 1), axis=1, kind="stable"), 1)
            line = np.arange(len(rows))[:, None]
            near[rows] = all_near[line, best]
            kept = np.concatenate((ids[rows], np.where(score > -np.inf, found, -1)), axis=1)[line, best]
            state = np.concatenate((open_[rows], score > -np.inf), axis=1)[line, best]
            ids[rows], open_[rows] = kept, state


def pruned(vectors: np.ndarray, near: np.ndarray, ids: np.ndarray, degree: int, relax: float) -> np.ndarray:
    """At most ``degree`` diverse neighbours out of the proposals of each point; -1 marks no proposal.

    Distances are squared chords, 2 - 2 cos; a proposal goes when ``relax`` times its distance to a chosen one is within its
    distance to the point.
    """
    order = np.argsort(-np.where(ids >= 0, near, -np.inf), axis=1, kind="stable")
    ids, near = np.take_along_axis(ids, order, 1), np.take_along_axis(near, order, 1)
    alive = ids >= 0
    own = 2 - 2 * near
    out = np.full((len(ids), degree), -1, dtype=np.int64)
    rows = np.arange(len(ids))
    cloud = vectors[ids]
    for turn in range(degree):
        first = np.argmax(alive, axis=1)
        live = alive[rows, first]
        if not live.any():
            break
        out[live, turn] = ids[rows[live], first[live]]
        between = 2 - 2 * np.matmul(cloud, cloud[rows, first][:, :, None])[:, :, 0]
        alive &= relax * between > own
        alive[rows, first] = False
    return out


def _linked_back(graph: Graph, points: np.ndarray, relax: float) -> None:
    """The edges of new points, in the other direction."""
    vectors, edges = graph.vectors, graph.edges
    degree = edges.shape[1]
    source = np.repeat(points, degree)
    target = edges[points].ravel()
    source, target = source[target >= 0], target[target >= 0]
    near = np.einsum("ij,ij->i", vectors[source], vectors[target])
    order = np.lexsort((-near, target))
    source, target = source[order], target[order]
    nodes, first, count = np.unique(target, return_index=True, return_counts=True)
    # proposals of a node: what it has, and as many new ones as it may have, nearest first
    place = np.arange(len(target)) - np.repeat(first, count)
    new = np.full((len(nodes), degree), -1, dtype=np.int64)
    fits = place < degree
    new[np.repeat(np.arange(len(nodes)), count)[fits], place[fits]] = source[fits]
    both = np.concatenate((edges[nodes], new), axis=1)
    few = (both >= 0).sum(axis=1) <= degree
    ordered = np.take_along_axis(both[few], np.argsort(both[few] < 0, axis=1, kind="stable"), 1)
    edges[nodes[few]] = ordered[:, :degree]
    for i in range(0, len(nodes), 1024):
        part = np.flatnonzero(~few)[i : i + 1024]
        if len(part):
            near = np.matmul(vectors[both[part]], vectors[nodes[part]][:, :, None])[:, :, 0]
            edges[nodes[part]] = pruned(vectors, near, both[part], degree, relax)


def built(vectors: np.ndarray, degree: int = DEGREE, beam: int = BEAM, relax: float = RELAX) -> Graph:
    """Graph over vectors of length one; the order of points is drawn from a fixed seed."""
    n = len(vectors)
    edges = np.full((n, degree), -1, dtype=np.int64)
    start = int(np.argmax(vectors @ vectors.mean(axis=0))) if n else 0
    graph = Graph(vectors, edges, start)
    order = np.random.default_rng(0).permutation(n)
    order = order[order != start]
    done = 0
    while done < len(order):
        size = max(1, min(done + 1, 512, CELLS // n))
        points = order[done : done + size]
        ids, near = graph._search(vectors[points], min(beam, n))
        for i in range(0, len(points), 256):
            part = points[i : i + 256]
            edges[part] = pruned(vectors, near[i : i + 256], ids[i : i + 256], degree, relax)
        _linked_back(graph, points, relax)
        done += len(points)
    return graph
