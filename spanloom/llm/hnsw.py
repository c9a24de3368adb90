"""Hierarchical navigable small-world graphs over flat neighbour arrays.

All steps work on whole batches: points are inserted and queries are answered hundreds at a time,
each step of the beam being a few array operations for all of them.
"""

from __future__ import annotations

import numpy as np

#: Neighbours of a point on the ground layer; half of that on the layers above.
GROUND = 32
BEAM_BUILD = 48
BEAM_SEARCH = 96
BATCH = 256


class Graph:
    """A graph over unit vectors ``x``; ``layers[l]`` holds the neighbours (-1: none) on layer l."""

    def __init__(self, x: np.ndarray, ground: int = GROUND, beam: int = BEAM_BUILD, seed: int = 3):
        self.x = np.ascontiguousarray(x, np.float32)
        self.ground = ground
        n = len(x)
        rng = np.random.default_rng(seed)
        level = np.minimum((-np.log(1 - rng.random(n)) / np.log(ground / 2)).astype(int), 6) if n else np.zeros(0, int)
        order = np.argsort(-level, kind="stable")  # points of the upper layers come first
        self.top = int(level[order[0]]) if n else 0
        self.layers = []
        self.links = []
        for lay in range(self.top + 1):
            width = ground if lay == 0 else ground // 2
            self.layers.append(np.full((n, width), -1, np.int32))
            self.links.append(np.full((n, width), -np.inf, np.float32))
        self.entry = int(order[0]) if n else -1
        self.seen = np.zeros((0, n), np.uint8)
        self.mark = np.zeros((0, n), np.int32)
        # layer by layer from the top: every point of a layer is inserted before the next layer begins
        for lay in range(self.top, -1, -1):
            self._fill(lay, order[level[order] >= lay], beam)
        del self.links

    def _fill(self, lay: int, points: np.ndarray, beam: int) -> None:
        done = 0
        while done < len(points):
            size = min(len(points) - done, BATCH, max(done, 64))
            new = points[done : done + size]
            near = self.x[new] @ self.x[new].T
            near[np.arange(size), np.arange(size)] = -np.inf
            keep = min(beam, size - 1)
            if keep > 0:
                at = np.argpartition(-near, keep - 1, axis=1)[:, :keep]
                ids, sims = new[at].astype(np.int32), np.take_along_axis(near, at, 1)
            else:
                ids, sims = np.zeros((size, 0), np.int32), np.zeros((size, 0), np.float32)
            if done:
                starts = self._descend(self.x[new], lay)
                found, how = self._beam(self.x[new], starts, lay, beam)
                ids, sims = np.hstack([ids, found]), np.hstack([sims, how])
            if ids.shape[1]:
                by = np.argsort(-sims, axis=1, kind="stable")[:, :beam]
                self._connect(lay, new, np.take_along_axis(ids, by, 1), np.take_along_axis(sims, by, 1))
            done += size

    def _descend(self, q: np.ndarray, lay: int) -> np.ndarray:
        """Entry points of every query on ``lay``: the best found on the layers above."""
        at = np.full((len(q), 1), self.entry, np.int32)
        for up in range(self.top, lay, -1):
            at, _ = self._beam(q, at, up, 4)
        return at

    def _beam(self, q: np.ndarray, starts: np.ndarray, lay: int, beam: int, expand: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """Best ``beam`` points of a layer for every query, by best-first search from its starts."""
        n, (rows, width) = len(self.x), (len(q), self.layers[lay].shape[1])
        if len(self.seen) < rows:
            self.seen = np.zeros((max(rows, BATCH), n), np.uint8)
            self.mark = np.zeros((max(rows, BATCH), n), np.int32)
        seen, mark = self.seen[:rows], self.mark
        seen[:] = 0
        ids = np.full((rows, beam), -1, np.int32)
        sims = np.full((rows, beam), -np.inf, np.float32)
        k = min(beam, starts.shape[1])
        ids[:, :k] = starts[:, :k]
        r = np.repeat(np.arange(rows), k)
        flat = ids[:, :k].ravel()
        ok = flat >= 0
        first = np.full(len(flat), -np.inf, np.float32)
        first[ok] = np.einsum("nd,nd->n", self.x[flat[ok]], q[r[ok]])
        sims[:, :k] = first.reshape(rows, k)
        seen[r[ok], flat[ok]] = 1
        by = np.argsort(-sims, axis=1, kind="stable")
        ids, sims = np.take_along_axis(ids, by, 1), np.take_along_axis(sims, by, 1)
        spent = ids < 0
        live = np.arange(rows)
        nbs = self.layers[lay]
        while len(live):
            free = ~spent[live]
            going = free.any(axis=1)
            live, free = live[going], free[going]
            if not len(live):
                break
            pick = np.argsort(~free, axis=1, kind="stable")[:, :expand]
            usable = np.take_along_axis(free, pick, 1)
            sp = spent[live]
            np.put_along_axis(sp, pick, True, 1)
            spent[live] = sp
            source = np.where(usable, np.take_along_axis(ids[live], pick, 1), -1)
            nb = np.where((source >= 0)[:, :, None], nbs[source], -1).reshape(len(live), -1)
            rr = np.repeat(np.arange(len(live)), nb.shape[1])
            flat = nb.ravel()
            ok = flat >= 0
            ok[ok] = seen[live[rr[ok]], flat[ok]] == 0
            where = np.flatnonzero(ok)
            rows_of, ids_of = live[rr[where]], flat[where]
            mark[rows_of, ids_of] = where  # a point met twice in a step counts once
            where = where[mark[rows_of, ids_of] == where]
            rows_of, ids_of = live[rr[where]], flat[where]
            seen[rows_of, ids_of] = 1
            fresh = np.full(len(flat), -np.inf, np.float32)
            fresh[where] = np.einsum("nd,nd->n", self.x[ids_of], q[rows_of])
            nb = np.where(fresh > -np.inf, flat, -1).reshape(len(live), -1)
            fresh = fresh.reshape(len(live), -1)
            all_ids = np.hstack([ids[live], nb])
            all_sims = np.hstack([sims[live], fresh])
            all_spent = np.hstack([spent[live], nb < 0])
            best = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
            s = np.take_along_axis(all_sims, best, 1)
            best = np.take_along_axis(best, np.argsort(-s, axis=1, kind="stable"), 1)
            ids[live] = np.take_along_axis(all_ids, best, 1)
            sims[live] = np.take_along_axis(all_sims, best, 1)
            spent[live] = np.take_along_axis(all_spent, best, 1)
        return ids, sims

    def _connect(self, lay: int, new: np.ndarray, ids: np.ndarray, sims: np.ndarray) -> None:
        """Links new points to a spread-out choice of their candidates, and those back to them."""
        nbs, links = self.layers[lay], self.links[lay]
        width = nbs.shape[1]
        rows, n = ids.shape
        chosen = np.zeros((rows, n), bool)
        if n > width // 2:
            cand = self.x[np.maximum(ids, 0)]
            among = cand @ cand.transpose(0, 2, 1)
            worst = np.full((rows, n), -np.inf, np.float32)  # similarity to the nearest chosen one
            count = np.zeros(rows, int)
            for c in range(n):
                take = (sims[:, c] > worst[:, c]) & (ids[:, c] >= 0) & (count < width // 2)
                chosen[:, c] = take
                count += take
                np.maximum(worst, np.where(take[:, None], among[:, c], -np.inf), out=worst)
        # free places go to the nearest of the others
        rank = np.where(ids < 0, 2 * n + np.arange(n), np.where(chosen, 0, n) + np.arange(n))
        pick = np.argsort(rank, axis=1)[:, : max(1, width // 2)]
        to, how = np.take_along_axis(ids, pick, 1), np.take_along_axis(sims, pick, 1)
        how = np.where(to >= 0, how, -np.inf)
        src = np.concatenate([np.repeat(new, to.shape[1]), to.ravel()])
        dst = np.concatenate([to.ravel(), np.repeat(new, to.shape[1])])
        sim = np.concatenate([how.ravel(), how.ravel()])
        good = (src >= 0) & (dst >= 0)
        src, dst, sim = src[good], dst[good], sim[good]
        touched = np.unique(src)
        old = nbs[touched]
        os, od = np.repeat(touched, width), old.ravel()
        keep = od >= 0
        src = np.concatenate([src, os[keep]])
        dst = np.concatenate([dst, od[keep]])
        sim = np.concatenate([sim, links[touched].ravel()[keep]])
        by = np.lexsort((dst, -sim, src))
        src, dst, sim = src[by], dst[by], sim[by]
        once = np.ones(len(src), bool)
        once[1:] = (src[1:] != src[:-1]) | (dst[1:] != dst[:-1])
        src, dst, sim = src[once], dst[once], sim[once]
        start = np.searchsorted(src, touched)
        place = np.arange(len(src)) - np.repeat(start, np.diff(np.append(start, len(src))))
        fits = place < width
        nbs[touched] = -1
        links[touched] = -np.inf
        nbs[src[fits], place[fits]] = dst[fits]
        links[src[fits], place[fits]] = sim[fits]

    def search(self, q: np.ndarray, beam: int = BEAM_SEARCH, own: np.ndarray | None = None) -> np.ndarray:
        """Ids of the best ``beam`` points of every query, best first (-1: none).

        ``own``: the queries are these points of the graph and the search starts from them.
        """
        out = np.full((len(q), min(beam, max(1, len(self.x)))), -1, np.int32)
        if not len(self.x):
            return out
        beam = out.shape[1]
        for a in range(0, len(q), BATCH):
            part = np.ascontiguousarray(q[a : a + BATCH], np.float32)
            starts = self._descend(part, 0) if own is None else np.asarray(own[a : a + BATCH], np.int32)[:, None]
            out[a : a + BATCH] = self._beam(part, starts, 0, beam)[0]
        return out

    def arrays(self) -> dict[str, np.ndarray]:
        """The graph as flat arrays, for storage."""
        return {"x": self.x, "entry": np.array([self.entry]), **{f"layer{i}": a for i, a in enumerate(self.layers)}}

    @classmethod
    def of(cls, arrays: dict[str, np.ndarray]) -> Graph:
        g = cls.__new__(cls)
        g.x, g.entry = arrays["x"], int(arrays["entry"][0])
        g.layers = [arrays[f"layer{i}"] for i in range(sum(k.startswith("layer") for k in arrays))]
        g.top, g.ground = len(g.layers) - 1, g.layers[0].shape[1]
        g.seen = np.zeros((0, len(g.x)), np.uint8)
        g.mark = np.zeros((0, len(g.x)), np.int32)
        return g
