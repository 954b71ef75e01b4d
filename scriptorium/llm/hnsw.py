"""Hierarchical navigable small-world graph of one shard, as flat neighbour arrays, searched in lockstep.

The graph is built in bulk: candidate lists come from blocked matrix products (exact within the shard), the
usual diversity rule picks the links, and links are made mutual. A search begins at the nearest rows of the level
above and moves a whole block of queries at a time: each step expands the best open candidates of every query and merges their neighbours into its beam.
"""

from __future__ import annotations

import numpy as np

NONE = np.int64(-(1 << 62))


def nearest_inside(vectors: np.ndarray, count: int, block: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Exact ids and cosines of the ``count`` nearest other rows, by descending cosine, then ascending id; -1 pads."""
    n = len(vectors)
    count = min(count, n - 1)
    ids = np.full((n, max(count, 0)), -1, np.int64)
    sims = np.full((n, max(count, 0)), -np.inf, np.float32)
    if count <= 0:
        return ids, sims
    for a in range(0, n, block):
        b = min(a + block, n)
        product = vectors[a:b] @ vectors.T
        product[np.arange(b - a), np.arange(a, b)] = -np.inf
        top = np.argpartition(product, n - count, axis=1)[:, n - count :]
        values = np.take_along_axis(product, top, 1)
        order = np.lexsort((top, -values), axis=1)
        ids[a:b] = np.take_along_axis(top, order, 1)
        sims[a:b] = np.take_along_axis(values, order, 1)
    return ids, sims


def diverse(vectors: np.ndarray, ids: np.ndarray, sims: np.ndarray, most: int, block: int = 2048) -> np.ndarray:
    """Of each row's candidates, those nearer to the row than to any candidate taken before; at most ``most``."""
    n, width = ids.shape
    keep = np.zeros((n, width), bool)
    for a in range(0, n, block):
        b = min(a + block, n)
        close = vectors[ids[a:b]]
        among = np.einsum("bid,bjd->bij", close, close, optimize=True)
        taken = keep[a:b]
        count = np.zeros(b - a, np.int64)
        for j in range(width):
            covered = (taken[:, :j] & (among[:, j, :j] > sims[a:b, j : j + 1])).any(1)
            taken[:, j] = ~covered & (count < most) & (ids[a:b, j] >= 0)
            count += taken[:, j]
    return keep


def mutual(n: int, source: np.ndarray, target: np.ndarray, sims: np.ndarray, width: int) -> np.ndarray:
    """Neighbour array of the links in both directions; the nearest ``width`` of each row, -1 pads."""
    a, b, s = np.concatenate([source, target]), np.concatenate([target, source]), np.concatenate([sims, sims])
    _, first = np.unique(a * n + b, return_index=True)
    a, b, s = a[first], b[first], s[first]
    order = np.lexsort((b, -s, a))
    a, b = a[order], b[order]
    start = np.searchsorted(a, np.arange(n))
    place = np.arange(len(a)) - start[a]
    links = np.full((n, width), -1, np.int64)
    good = place < width
    links[a[good], place[good]] = b[good]
    return links


class FlatHNSW:
    """``members`` holds, for each level, the row ids on it; ``links`` the neighbour array among those rows."""

    def __init__(self, vectors: np.ndarray, links: int = 12, candidates: int = 32, seed: int = 7) -> None:
        self.vectors = vectors
        self.members: list[np.ndarray] = []
        self.links: list[np.ndarray] = []
        n = len(vectors)
        self.near, self.near_sims = nearest_inside(vectors, candidates)
        height = np.floor(-np.log(np.maximum(np.random.default_rng(seed).random(n), 1e-12)) / np.log(links)).astype(np.int64)
        level, rows = 0, np.arange(n)
        while len(rows):
            local = vectors[rows] if level else vectors
            ids, sims = (self.near, self.near_sims) if not level else nearest_inside(local, candidates)
            keep = diverse(local, ids, sims, links)
            source, column = np.nonzero(keep)
            self.members.append(rows)
            self.links.append(mutual(len(rows), source, ids[source, column], sims[source, column], 2 * links if not level else links))
            level += 1
            if len(rows) <= 2 * links:
                break
            rows = np.flatnonzero(height >= level)

    def entry(self, queries: np.ndarray, count: int) -> np.ndarray:
        """Rows on level 0 where each query's search begins: the ``count`` nearest of the level above, which a blocked
        product scans as a whole, being a twelfth of the rows; where there is no such level, the first row."""
        if len(self.members) < 2:
            return np.zeros((len(queries), 1), np.int64)
        above = self.members[1]
        score = queries @ self.vectors[above].T
        count = min(count, len(above))
        return above[np.argpartition(score, len(above) - count, axis=1)[:, len(above) - count :]]

    def search(self, queries: np.ndarray, k: int, ef: int, expand: int = 3, block: int = 2048, start: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids and cosines of about the ``k`` nearest rows to each query; -1 pads. A query that is itself in the graph
        may ``start`` at its own row in place of those of the level above."""
        ids = np.full((len(queries), k), -1, np.int64)
        sims = np.full((len(queries), k), -np.inf, np.float32)
        for a in range(0, len(queries), block):
            keys = self._beam(queries[a : a + block], max(ef, k), expand, None if start is None else start[a : a + block])
            keys = -np.sort(-keys, axis=1)[:, :k]
            good = keys != NONE
            ids[a : a + block, : keys.shape[1]] = np.where(good, (keys >> 1) & 0x7FFFFFFF, -1)
            sims[a : a + block, : keys.shape[1]] = np.where(good, self._score(keys), -np.inf)
        return ids, sims

    @staticmethod
    def _key(sims: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """One sortable integer of cosine, id and an open flag (0)."""
        bits = np.ascontiguousarray(sims, np.float32).view(np.int32)
        bits = np.where(bits < 0, bits ^ 0x7FFFFFFF, bits).astype(np.int64)
        return bits << 32 | ids << 1

    @staticmethod
    def _score(keys: np.ndarray) -> np.ndarray:
        bits = (keys >> 32).astype(np.int32)
        return np.where(bits < 0, bits ^ 0x7FFFFFFF, bits).astype(np.int32).view(np.float32)

    def _beam(self, queries: np.ndarray, ef: int, expand: int, start: np.ndarray | None = None) -> np.ndarray:
        count, links = len(queries), self.links[0]
        seen = np.zeros((count, len(self.vectors) + 1), bool)  # the last column stands for padding
        seen[:, -1] = True
        start = self.entry(queries, min(ef // 4, 16)) if start is None else start[:, None]
        np.put_along_axis(seen, start, True, 1)
        beam = np.full((count, ef), NONE)
        beam[:, : start.shape[1]] = self._key(np.einsum("qd,qnd->qn", queries, self.vectors[start]), start)
        going = np.arange(count)
        while len(going):
            own = beam[going]
            open_keys = np.where((own & 1) == 0, own, NONE)
            width = min(expand, ef)
            at = np.argpartition(open_keys, ef - width, axis=1)[:, ef - width :] if width < ef else np.broadcast_to(np.arange(ef), own.shape)
            picked = np.take_along_axis(open_keys, at, 1)
            valid = picked != NONE
            live = valid.any(1)
            if not live.all():
                going, own, at, picked, valid = going[live], own[live], at[live], picked[live], valid[live]
                if not len(going):
                    break
            np.put_along_axis(own, at, np.take_along_axis(own, at, 1) | valid, 1)
            rows = np.where(valid, (picked >> 1) & 0x7FFFFFFF, 0)
            near = np.where(valid[:, :, None], links[rows], -1).reshape(len(going), -1)
            fresh = ~seen[going[:, None], near]
            q, c = np.nonzero(fresh)
            target = near[q, c]
            seen[going[q], target] = True
            new = np.full(near.shape, NONE)
            new[q, c] = self._key(np.einsum("pd,pd->p", queries[going[q]], self.vectors[target]), target)
            if width > 1:  # a row met twice in one step keeps one key
                new.sort(axis=1)
                new[:, 1:][new[:, 1:] == new[:, :-1]] = NONE
            merged = np.concatenate([own, new], 1)
            beam[going] = np.partition(merged, merged.shape[1] - ef, axis=1)[:, merged.shape[1] - ef :]
        return beam
