"""A robust-pruned directed graph over vectors, with searches in batches.

Points join in growing batches. A beam search over the graph so far proposes neighbours. Pruning keeps the
nearest proposal and drops those to which it is nearer, by a factor, than the point is; so long edges
in other directions stay. New edges also run backwards, and a point with too many is pruned again.
"""

from __future__ import annotations

import numpy as np

DEGREE = 32
BEAM = 64
ALPHA = 1.2
# Nodes that a search step opens for each query, and points that join at once at most.
OPEN = 4
BATCH = 512


class Graph:
    """x: unit vectors, all different."""

    def __init__(self, x: np.ndarray, seed: int = 7):
        self.x = np.ascontiguousarray(x, np.float32)
        n = len(x)
        self.next = np.full((n, DEGREE), -1, np.int32)
        self.start = int(np.argmax(self.x @ self.x.mean(0)))
        order = np.random.default_rng(seed).permutation(n)
        order = np.concatenate([[self.start], order[order != self.start]])
        done = 1
        while done < n:
            batch = order[done:done + min(BATCH, max(1, done // 2))]
            self._join(batch)
            done += len(batch)

    def search(self, q: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """(ids, distances) of the beam of each query, nearest first; ids are -1 beyond what was reached.

        Distance: 1 - cosine. Every step opens the nearest unopened nodes of each query's beam.
        """
        m = len(q)
        rows = np.arange(m)[:, None]
        seen = np.zeros((m, len(self.x) + 1), bool)  # the last column takes absent neighbours
        ids = np.full((m, beam), -1, np.int64)
        dist = np.full((m, beam), np.inf, np.float32)
        opened = np.ones((m, beam), bool)
        ids[:, 0], dist[:, 0], opened[:, 0] = self.start, 1 - q @ self.x[self.start], False
        seen[:, self.start] = seen[:, -1] = True
        while True:
            choice = np.argsort(opened, axis=1, kind="stable")[:, :OPEN]  # the beam is sorted by distance
            fresh = ~opened[rows, choice]
            live = np.flatnonzero(fresh.any(1))
            if not len(live):
                return ids, dist
            at = live[:, None]
            new = self.next[np.where(fresh[live], ids[at, choice[live]], 0)]
            new = np.where(fresh[live][:, :, None], new, -1).reshape(len(live), -1).astype(np.int64)
            opened[at, choice[live]] = True
            new.sort(axis=1)
            new[:, 1:][new[:, 1:] == new[:, :-1]] = -1
            new[seen[at, new]] = -1
            seen[at, new] = True
            d = 1 - np.einsum("mkd,md->mk", self.x[new], q[live])
            d[new < 0] = np.inf
            all_ids, all_d = np.concatenate([ids[live], new], 1), np.concatenate([dist[live], d], 1)
            all_open = np.concatenate([opened[live], new < 0], 1)
            best = np.argsort(all_d, axis=1, kind="stable")[:, :beam]
            ids[live], dist[live] = np.take_along_axis(all_ids, best, 1), np.take_along_axis(all_d, best, 1)
            opened[live] = np.take_along_axis(all_open, best, 1)

    def _prune(self, points: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Diverse neighbours of each point out of its proposals (-1: none)."""
        ids = ids.copy()
        ids[ids == points[:, None]] = -1
        d = 1 - np.einsum("mkd,md->mk", self.x[ids], self.x[points])
        d[ids < 0] = np.inf
        order = np.argsort(d, axis=1, kind="stable")
        ids, d = np.take_along_axis(ids, order, 1), np.take_along_axis(d, order, 1)
        ids[:, 1:][ids[:, 1:] == ids[:, :-1]] = -1
        alive = (ids >= 0) & np.isfinite(d)
        out = np.full((len(points), DEGREE), -1, np.int64)
        vectors = self.x[ids]
        for k in range(DEGREE):
            first = alive.argmax(1)
            some = np.flatnonzero(alive[np.arange(len(points)), first])
            if not len(some):
                break
            kept = first[some]
            out[some, k] = ids[some, kept]
            between = 1 - np.einsum("mkd,md->mk", vectors[some], vectors[some, kept])
            # squared distances of unit vectors are proportional to 1 - cosine
            drop = ALPHA * ALPHA * between <= d[some]
            drop[np.arange(len(some)), kept] = True
            alive[some] &= ~drop
        return out

    def _join(self, batch: np.ndarray) -> None:
        found, _ = self.search(self.x[batch])
        self.next[batch] = chosen = self._prune(batch, found)
        to, by = chosen.ravel(), np.repeat(batch, DEGREE)
        to, by = to[to >= 0], by[to >= 0]
        order = np.argsort(to, kind="stable")
        to, by = to[order], by[order]
        nodes, first, count = np.unique(to, return_index=True, return_counts=True)
        full = (self.next[nodes] >= 0).sum(1)
        place = np.arange(len(to)) - np.repeat(first, count)
        room = np.repeat(full + count <= DEGREE, count)
        self.next[to[room], (np.repeat(full, count) + place)[room]] = by[room]
        over = np.flatnonzero(full + count > DEGREE)
        # nodes of like in-degree together, so that a hub does not widen the others' rows
        over = over[np.argsort(count[over], kind="stable")]
        at = 0
        while at < len(over):
            part = over[at:at + BATCH]
            while len(part) > 1 and len(part) * count[part[-1]] > BATCH * 64:
                part = part[:len(part) // 2]
            wide = np.full((len(part), int(count[part[-1]])), -1, np.int64)
            for r, k in enumerate(part):
                wide[r, :count[k]] = by[first[k]:first[k] + count[k]]
            self.next[nodes[part]] = self._prune(nodes[part], np.concatenate([self.next[nodes[part]].astype(np.int64), wide], 1))
            at += len(part)
