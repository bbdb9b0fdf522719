"""A hierarchical navigable small-world graph over unit vectors, in numpy.

Points are inserted in batches: a batch is searched in the graph so far, its members also
meet each other, and each is linked to neighbours chosen for diversity (a candidate closer
to a chosen neighbour than to the point is put last); links are mutual and lists that
overflow are chosen anew. Upper layers hold a geometrically falling share of the points.
Searches run for many queries in step, so the work per step is one matrix product.
"""

from __future__ import annotations

import numpy as np

M, M0, BUILD_BEAM, BATCH = 12, 24, 48, 512
#: Entries of a beam that are expanded in one step.
WIDE = 4


def _choose(ids: np.ndarray, sims: np.ndarray, vectors: np.ndarray, m: int) -> np.ndarray:
    """Up to m of each row's candidates (sorted by falling similarity, -1: none), diverse first."""
    q, c = ids.shape
    safe = np.maximum(ids, 0)
    cand = vectors[safe]
    between = np.matmul(cand, cand.transpose(0, 2, 1))
    taken, closest, count = np.zeros((q, c), bool), np.full((q, c), -2.0, np.float32), np.zeros(q, int)
    for k in range(c):
        ok = (ids[:, k] >= 0) & (count < m) & (sims[:, k] > closest[:, k])
        taken[:, k] = ok
        count += ok
        closest = np.where(ok[:, None], np.maximum(closest, between[:, k, :]), closest)
    # the rest fill up in order of similarity
    order = np.argsort(np.where(taken, 0, 1) + np.where(ids < 0, 2, 0), axis=1, kind="stable")[:, :m]
    return np.take_along_axis(ids, order, 1)


def _top(ids: np.ndarray, sims: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(-sims, axis=1, kind="stable")[:, :k]
    return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)


class Graph:
    """Base layer: M0 links a point. Layers above: point numbers and M links each."""

    def __init__(self, vectors: np.ndarray, base: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]]):
        self.vectors, self.base, self.layers = vectors, base, layers

    @classmethod
    def build(cls, vectors: np.ndarray, seed: int = 5) -> Graph:
        n = len(vectors)
        random = np.random.default_rng(seed)
        level = (-np.log(np.maximum(random.random(n), 1e-12)) / np.log(M)).astype(int)
        graph = cls(vectors, np.full((n, M0), -1, np.int32), [])
        for k in range(1, int(level.max(initial=0)) + 1):
            points = np.flatnonzero(level >= k)
            if len(points) < 2:
                break
            # the points of an upper layer are few: n / M ** k
            links = np.full((len(points), M), -1, np.int32)
            for i in range(0, len(points), BATCH):
                sims = vectors[points[i : i + BATCH]] @ vectors[points].T
                sims[np.arange(len(sims)), np.arange(i, i + len(sims))] = -2
                k_best = min(2 * M, len(points) - 1)
                ids = np.argpartition(-sims, k_best - 1, axis=1)[:, :k_best]
                ids, s = _top(ids, np.take_along_axis(sims, ids, 1), k_best)
                chosen = _choose(ids, s, vectors[points], M)
                links[i : i + len(sims), : chosen.shape[1]] = chosen
            graph.layers.append((points.astype(np.int32), links))
        done, size = 0, 64
        order = np.arange(n)
        while done < n:
            batch = order[done : done + size]
            graph._insert(batch, done)
            done += len(batch)
            size = min(BATCH, done)
        return graph

    def _insert(self, batch: np.ndarray, done: int) -> None:
        v = self.vectors
        q = v[batch]
        ids, sims = np.full((len(batch), 0), -1), np.zeros((len(batch), 0), np.float32)
        if done:
            ids, sims = self.search(q, BUILD_BEAM, limit=done)
        own = q @ q.T
        np.fill_diagonal(own, -2)
        k = min(BUILD_BEAM // 2, len(batch) - 1)
        if k > 0:
            near = np.argpartition(-own, k - 1, axis=1)[:, :k]
            ids = np.hstack([ids, batch[near]])
            sims = np.hstack([sims, np.take_along_axis(own, near, 1)])
        if not ids.shape[1]:
            return
        ids, sims = _top(ids, sims, 2 * M0)
        chosen = _choose(ids, sims, v, M0 // 2)
        self.base[batch, : chosen.shape[1]] = chosen
        # links back
        src, k = np.nonzero(chosen >= 0)
        to, back = chosen[src, k], batch[src]
        order = np.argsort(to, kind="stable")
        to, back = to[order], back[order]
        cuts = np.flatnonzero(np.r_[True, to[1:] != to[:-1]])
        over_ids, over_cand = [], []
        for i, (a, b) in enumerate(zip(cuts, np.r_[cuts[1:], len(to)], strict=True)):
            p, new = to[a], back[a:b]
            have = self.base[p][self.base[p] >= 0]
            both = np.r_[have, new[~np.isin(new, have)]]
            if len(both) <= M0:
                self.base[p, : len(both)] = both
            else:
                over_ids.append(p)
                over_cand.append(both)
        for i in range(0, len(over_ids), 256):
            points, lists = np.array(over_ids[i : i + 256]), over_cand[i : i + 256]
            width = max(map(len, lists))
            cand = np.full((len(points), width), -1)
            for r, x in enumerate(lists):
                cand[r, : len(x)] = x
            sims = np.einsum("qcd,qd->qc", v[np.maximum(cand, 0)], v[points])
            cand, sims = _top(cand, np.where(cand >= 0, sims, -3), 4 * M0)
            self.base[points] = -1
            chosen = _choose(cand, sims, v, M0)
            self.base[points, : chosen.shape[1]] = chosen

    def _enter(self, q: np.ndarray, limit: int) -> np.ndarray:
        """Greedy descent through the upper layers to a start on the base layer."""
        at = np.zeros(len(q), np.int64)
        for points, links in reversed(self.layers):
            if limit < len(self.vectors) and not (points < limit).any():
                continue
            here = np.searchsorted(points, at)
            here = np.where((here < len(points)) & (points[np.minimum(here, len(points) - 1)] == at), here, 0)
            here = np.where(points[here] < limit, here, 0)
            best = np.einsum("qd,qd->q", self.vectors[points[here]], q)
            active = np.arange(len(q))
            while len(active):
                near = links[here[active]]
                real = (near >= 0) & (points[np.maximum(near, 0)] < limit)
                sims = np.where(real, np.einsum("qcd,qd->qc", self.vectors[points[np.maximum(near, 0)]], q[active]), -3)
                k = sims.argmax(1)
                s = sims[np.arange(len(active)), k]
                better = s > best[active]
                active, k, s, near = active[better], k[better], s[better], near[better]
                here[active] = near[np.arange(len(active)), k]
                best[active] = s
            at = np.where(points[here] < limit, points[here], 0).astype(np.int64)
        return at

    def search(self, q: np.ndarray, beam: int, limit: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The `beam` nearest points found for each query, nearest first (-1: none)."""
        limit = len(self.vectors) if limit is None else limit
        out_i, out_s = np.full((len(q), beam), -1), np.full((len(q), beam), -3, np.float32)
        step = max(16, min(512, 8_000_000 // max(limit, 1)))
        for i in range(0, len(q), step):
            out_i[i : i + step], out_s[i : i + step] = self._search(q[i : i + step], beam, limit)
        return out_i, out_s

    def _search(self, q: np.ndarray, beam: int, limit: int) -> tuple[np.ndarray, np.ndarray]:
        v, n = self.vectors, len(q)
        start = self._enter(q, limit)
        ids, sims = np.full((n, beam), -1), np.full((n, beam), -3, np.float32)
        ids[:, 0], sims[:, 0] = start, np.einsum("qd,qd->q", v[start], q)
        opened = np.zeros((n, beam), bool)
        seen = np.zeros((n, limit), bool)
        seen[np.arange(n), start] = True
        active = np.arange(n)
        wide = min(WIDE, beam)
        while len(active):
            open_sims = np.where(opened[active] | (ids[active] < 0), -4, sims[active])
            pick = np.argpartition(-open_sims, wide - 1, axis=1)[:, :wide] if wide < beam else np.argsort(-open_sims, axis=1)
            live = np.take_along_axis(open_sims, pick, 1) > -4
            going = live.any(1)
            active, pick, live = active[going], pick[going], live[going]
            if not len(active):
                break
            row = np.arange(len(active))[:, None]
            flag = opened[active]
            flag[row, pick] |= live
            points = np.where(live, ids[active][row, pick], -1)
            near = np.where(points[:, :, None] >= 0, self.base[np.maximum(points, 0)], -1).reshape(len(active), -1)
            near = np.where(near < limit, near, -1)
            near.sort(axis=1)
            real = near >= 0
            real[:, 1:] &= near[:, 1:] != near[:, :-1]
            real &= ~seen[active[:, None], np.maximum(near, 0)]
            r, c = np.nonzero(real)
            seen[active[r], near[r, c]] = True
            new = np.full(near.shape, -3, np.float32)
            new[r, c] = np.einsum("kd,kd->k", v[near[r, c]], q[active[r]])
            all_ids = np.hstack([ids[active], np.where(real, near, -1)])
            all_sims = np.hstack([sims[active], new])
            all_open = np.hstack([flag, np.zeros(near.shape, bool)])
            keep = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
            ids[active], sims[active], opened[active] = (np.take_along_axis(x, keep, 1) for x in (all_ids, all_sims, all_open))
        return _top(ids, sims, beam)
