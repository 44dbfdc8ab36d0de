"""Vantage-point trees over 64-bit fingerprints, for exact pairs within a Hamming radius.

A node splits points by their distance from a vantage point: near ones differ in at most `limit` bits. Distances of
two points within the radius r of each other differ by r at most (the triangle inequality), so a point can have a
partner on the other side only if its own distance is within r of the limit. A point lives in one leaf, its home, and
visits the others that may hold partners; a pair of homes in different leaves meets once, where they part: the near
point visits the far side, and as a visitor follows both sides of later nodes where its distance leaves that open.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np

#: Vantage points tried for a split, and points that judge them.
TRIED, JUDGES = 8, 1024
#: A split must save this share of the comparisons.
SAVING = 0.1
#: Comparisons that a leaf makes rather than be split, and pivots of a leaf that cannot be.
LEAF_WORK, PIVOTS = 1 << 19, 8


def distances(points: np.ndarray, vantage: np.ndarray) -> np.ndarray:
    return np.bitwise_count(points ^ vantage).astype(np.int64)


def split(points: np.ndarray, radius: int, visitors: int = 0) -> tuple[np.uint64, int] | None:
    """The vantage point and limit, of those tried, that leave the fewest comparisons; None where none saves enough."""
    draw = np.random.default_rng(len(points))
    judges = points if len(points) <= JUDGES else points[draw.integers(0, len(points), JUDGES)]
    n, best = len(judges), (1 - SAVING, None)
    more = visitors / max(len(points), 1)
    for vantage in np.unique(judges[draw.integers(0, n, TRIED)]):
        upto = np.cumsum(np.bincount(distances(judges, vantage), minlength=65)[:65])
        at = lambda k: np.concatenate([np.zeros(max(0, -k), np.int64), upto, np.full(max(0, k), n)])[max(0, k) : max(0, k) + 65]
        near, below, above = upto / n, at(-radius) / n, at(radius) / n
        work = near * (near + more * above) + (1 - near) * (1 - below + more * (1 - below))
        limit = int(np.argmin(work[:64]))
        if work[limit] < best[0] * (1 + more):
            best = (work[limit] / (1 + more), (vantage, limit))
    return best[1]


@dataclass(frozen=True)
class Tree:
    """Nodes as arrays; children at or above zero are nodes, others are leaves: ~leaf."""

    vantage: np.ndarray
    limit: np.ndarray
    near: np.ndarray
    far: np.ndarray
    leaves: int

    @staticmethod
    def fit(sample: np.ndarray, leaves: int, radius: int) -> Tree:
        """Split the leaf with the most sample points, again and again, until there are `leaves` or none can be split."""
        nodes: list[list] = []
        heap = [(-len(sample), 0, sample, None)]
        done: list[tuple[int, int] | None] = []
        while heap:
            _, order, points, parent = heapq.heappop(heap)
            found = split(points, radius) if len(points) > 1 and len(heap) + len(done) + 1 < leaves else None
            if found is None:
                done.append(parent)
                continue
            here = len(nodes)
            nodes.append([*found, 0, 0])
            if parent:
                nodes[parent[0]][2 + parent[1]] = here
            near = distances(points, found[0]) <= found[1]
            for side, part in enumerate((points[near], points[~near])):
                heapq.heappush(heap, (-len(part), 2 * here + side + 1, part, (here, side)))
        for leaf, parent in enumerate(done):
            if parent:
                nodes[parent[0]][2 + parent[1]] = ~leaf
        columns = list(zip(*nodes, strict=True)) or [(), (), (), ()]
        return Tree(*(np.array(c, kind) for c, kind in zip(columns, (np.uint64, np.int64, np.int64, np.int64), strict=True)), len(done))

    def places(self, points: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(point, leaf, at home) for the home of each point and for each leaf that it visits."""
        who = np.arange(len(points))
        if not len(self.vantage):
            return who, np.zeros(len(points), np.int64), np.ones(len(points), bool)
        at, home, out = np.zeros(len(points), np.int64), np.ones(len(points), bool), []
        while len(who):
            d, limit = distances(points[who], self.vantage[at]), self.limit[at]
            near = (d <= limit) | ~home & (d <= limit + radius)
            far = (d > limit) | (d > limit - radius)
            who = np.concatenate([who[near], who[far]])
            stays = np.concatenate([home[near], home[far] & (d > limit)[far]])
            at, home = np.concatenate([self.near[at[near]], self.far[at[far]]]), stays
            leaf = at < 0
            out.append((who[leaf], ~at[leaf], home[leaf]))
            who, at, home = who[~leaf], at[~leaf], home[~leaf]
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


class Shard:
    """Points of one group and the links found between them; links join points to parts, never all pairs."""

    def __init__(self, homes: np.ndarray, others: np.ndarray, radius: int, within: bool) -> None:
        """`within`: homes are compared with each other, too, not only with the others."""
        self.points, self.radius, self.within = np.concatenate([homes, others]), radius, within
        self.parent = np.arange(len(self.points))
        self.homes = len(homes)
        self.compared = 0
        self.links: list[tuple[int, int]] = []

    def find(self) -> list[tuple[int, int]]:
        stack = [(np.arange(self.homes), np.arange(self.homes, len(self.points)))]
        while stack:
            h, v = stack.pop()
            if not len(h) or len(h) + len(v) < 2:
                continue
            work = len(h) * (len(h) * self.within + len(v))
            found = split(self.points[h], self.radius, len(v)) if work > LEAF_WORK else None
            if found is None:
                self._leaf(h, v, work)
                continue
            vantage, limit = found
            d, e = distances(self.points[h], vantage), distances(self.points[v], vantage)
            crossing = h[(d <= limit) & (d > limit - self.radius)] if self.within else h[:0]
            stack.append((h[d <= limit], v[e <= limit + self.radius]))
            stack.append((h[d > limit], np.concatenate([v[e > limit - self.radius], crossing])))
        return [(int(self.points[a].view(np.int64)), int(self.points[b].view(np.int64))) for a, b in self.links]

    def roots(self, at: np.ndarray) -> np.ndarray:
        up = self.parent[at]
        while True:
            above = self.parent[up]
            if np.array_equal(above, up):
                self.parent[at] = up
                return up
            up = above

    def _join(self, a: np.ndarray, b: np.ndarray) -> None:
        for x, y in np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1).T.tolist():
            while self.parent[x] != x:
                x = int(self.parent[x])
            while self.parent[y] != y:
                y = int(self.parent[y])
            if x != y:
                self.parent[max(x, y)] = min(x, y)
                self.links.append((x, y))

    def _leaf(self, h: np.ndarray, v: np.ndarray, work: int) -> None:
        """Compare all homes of a leaf; in a large one what a few pivots have joined is not compared with itself."""
        every = np.concatenate([h, v]) if self.within else v
        if work <= LEAF_WORK:
            return self._compare(h, every)
        for pivot in h[np.linspace(0, len(h) - 1, PIVOTS).astype(np.int64)]:
            self._compare(np.array([pivot]), every)
        joined = self.roots(h)
        values, counts = np.unique(joined, return_counts=True)
        main = values[np.argmax(counts)]
        self._compare(h[joined != main], every)
        self._compare(h[joined == main], v[self.roots(v) != main])

    def _compare(self, rows: np.ndarray, columns: np.ndarray) -> None:
        step = max(1, (1 << 20) // max(len(columns), 1))
        values = self.points[columns]
        for k in range(0, len(rows), step):
            some = rows[k : k + step]
            self.compared += len(some) * len(columns)
            i, j = np.nonzero(np.bitwise_count(self.points[some][:, None] ^ values[None, :]) <= self.radius)
            a, b = self.roots(some)[i], self.roots(columns)[j]
            apart = a != b
            if apart.any():
                self._join(a[apart], b[apart])
