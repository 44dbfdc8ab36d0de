"""Boosted regression trees grown best leaf first from histograms of residuals, for folds of any size."""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np

from tidegate.errors import EvaluationError
from tidegate.operators.mergeable import Estimator

#: Cells of even width from which the edges of bins are chosen.
CELLS = 4096


@dataclass
class Forest:
    """What a fold's training knows: the bins' edges, finished trees, and the nodes of the tree at work.

    A tree is a heap: node k has the children 2k + 1 and 2k + 2. `feature` is -1 where a node is a leaf.
    """

    low: np.ndarray
    width: np.ndarray
    rows: float = 0.0
    edges: list[np.ndarray] | None = None
    base: float = 0.0
    feature: np.ndarray | None = None
    limit: np.ndarray | None = None
    value: np.ndarray | None = None
    grown: int = 0
    sums: np.ndarray | None = None
    gain: np.ndarray | None = None


@dataclass(frozen=True)
class LeafwiseTrees(Estimator):
    """Gradient boosting of squared errors: `trees` trees of at most `leaves` leaves and `depth` levels, best leaf first.

    Two rounds choose each feature's bins; then each tree takes a round for each level. A round sums residuals and counts
    rows by node, feature and bin, for left children only: right ones are their parent less those. A node's best split
    does not depend on other nodes, so all nodes of a level are looked at in one round, and the tree then keeps the splits
    that growing the best leaf first would make. A split leaves `least` rows on each side at least; equal gains go to the
    first feature and the lowest bin. Missing values are not taken.
    """

    trees: int = 40
    leaves: int = 7
    depth: int = 3
    rate: float = 0.05
    bins: int = 64
    least: int = 20
    name = "leafwise-trees"

    def __post_init__(self) -> None:
        if min(self.trees, self.leaves - 1, self.depth, self.bins - 1, self.least) < 1 or self.rate <= 0 or self.depth > 8:
            raise EvaluationError("tree parameters must be positive, with two leaves and bins at least and eight levels at most")

    def rounds(self, width: int) -> int:
        return 2 + self.trees * self.depth

    def size(self, width: int) -> int:
        return max(1 + width * CELLS, 2 * width * self.bins << self.depth) + 3 * self.trees << (self.depth + 1)

    @property
    def nodes(self) -> int:
        return (2 << self.depth) - 1

    def _place(self, forest: Forest, tree: int, x: np.ndarray, levels: int) -> np.ndarray:
        """Each row's node in a tree, at most `levels` below the root."""
        at = np.zeros(len(x), np.int64)
        for _ in range(levels):
            feature = forest.feature[tree, at]
            inner = feature >= 0
            right = x[np.arange(len(x)), np.maximum(feature, 0)] > forest.limit[tree, at]
            at = np.where(inner, 2 * at + 1 + right, at)
        return at

    def _score(self, forest: Forest, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), forest.base)
        for tree in range(forest.grown):
            out += self.rate * forest.value[tree, self._place(forest, tree, x, self.depth)]
        return out

    def partial(self, known, x, y, turn):
        width = x.shape[1]
        if turn == 0:
            if not np.isfinite(x).all():
                raise EvaluationError("features must be finite")
            return np.concatenate([x.min(axis=0), -x.max(axis=0)])
        if turn == 1:
            cells = np.minimum(((x - known.low) / known.width).astype(np.int64), CELLS - 1)
            return np.concatenate([[len(y), y.sum()], *(np.bincount(cells[:, j], minlength=CELLS) for j in range(width))])
        tree, level = divmod(turn - 2, self.depth)
        rest, node = y - self._score(known, x), self._place(known, tree, x, level)
        first = (1 << level) - 1
        # nodes of the level that are looked at: the root, or left children of nodes that were split
        here = node >= first if level == 0 else (node >= first) & (node % 2 == 1)
        x, rest, slot = x[here], rest[here], (node[here] - first) // (1 if level == 0 else 2)
        slots = 1 if level == 0 else 1 << (level - 1)
        out = np.zeros((2, slots, width, self.bins))
        for j in range(width):
            cell = slot * self.bins + np.searchsorted(known.edges[j], x[:, j], side="left")
            out[0, :, j] = np.bincount(cell, minlength=slots * self.bins).reshape(slots, self.bins)
            out[1, :, j] = np.bincount(cell, rest, slots * self.bins).reshape(slots, self.bins)
        return out.ravel()

    def merge(self, a, b, turn):
        return np.minimum(a, b) if turn == 0 else a + b

    def advance(self, known, state, width, turn):
        if turn == 0:
            low, high = state[:width], -state[width:]
            return Forest(low, np.where(high > low, (high - low) / CELLS, 1.0))
        if turn == 1:
            return self._binned(known, state, width)
        tree, level = divmod(turn - 2, self.depth)
        left = state.reshape(2, -1, width, self.bins)
        if level == 0:
            sums = left
        else:
            sums = np.empty((2, 1 << level, width, self.bins))
            sums[:, ::2], sums[:, 1::2] = left, known.sums - left
        forest = Forest(**vars(known))
        forest.feature, forest.limit, forest.value = known.feature.copy(), known.limit.copy(), known.value.copy()
        forest.sums, forest.gain = sums, np.zeros(self.nodes) if level == 0 else known.gain.copy()
        first = (1 << level) - 1
        for k in range(sums.shape[1]):
            if level == 0 or forest.feature[tree, (first + k - 1) // 2] >= 0:
                self._split(forest, tree, first + k, sums[:, k])
        if level + 1 == self.depth:
            self._prune(forest, tree)
            forest.grown, forest.sums, forest.gain = tree + 1, None, None
        return forest

    def _binned(self, known: Forest, state: np.ndarray, width: int) -> Forest:
        """Edges at cells that end a bin's share of the rows; values up to an edge lie below it."""
        rows, upto = state[0], state[2:].reshape(width, CELLS).cumsum(axis=1)
        edges = []
        for j in range(width):
            ends = np.unique(np.searchsorted(upto[j], rows * np.arange(1, self.bins) / self.bins))
            edges.append(known.low[j] + (ends[ends < CELLS - 1] + 1) * known.width[j])
        shape = (self.trees, self.nodes)
        return Forest(known.low, known.width, rows, edges, state[1] / rows, np.full(shape, -1), np.zeros(shape), np.zeros(shape))

    def _split(self, forest: Forest, tree: int, node: int, sums: np.ndarray) -> None:
        """Note a node's mean and, if one gains, its best split; the children's means follow from it."""
        count, total = sums[0, 0].sum(), sums[1, 0].sum()
        forest.value[tree, node] = total / count if count else 0.0
        n, g = sums[0].cumsum(axis=1)[:, :-1], sums[1].cumsum(axis=1)[:, :-1]
        fits = (n >= self.least) & (count - n >= self.least)
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = np.where(fits, g**2 / n + (total - g) ** 2 / (count - n) - total**2 / count, -np.inf)
        for j, edges in enumerate(forest.edges):
            gain[j, len(edges) :] = -np.inf
        best = int(np.argmax(gain))
        j, b = divmod(best, self.bins - 1)
        if gain[j, b] > 1e-12:
            forest.feature[tree, node], forest.limit[tree, node], forest.gain[node] = j, forest.edges[j][b], gain[j, b]
            for child, (rows, rest) in ((1, (n[j, b], g[j, b])), (2, (count - n[j, b], total - g[j, b]))):
                forest.value[tree, 2 * node + child] = rest / rows

    def _prune(self, forest: Forest, tree: int) -> None:
        """Keep the splits that growing the best leaf first makes until there are `leaves`."""
        heap, kept = [(-forest.gain[0], 0)], set()
        while heap and len(kept) + 1 < self.leaves:
            gain, node = heapq.heappop(heap)
            if gain < 0:
                kept.add(node)
                for child in (2 * node + 1, 2 * node + 2):
                    if child < len(forest.gain):
                        heapq.heappush(heap, (-forest.gain[child], child))
        forest.feature[tree, [k for k in range(self.nodes) if k not in kept]] = -1

    def predict(self, known, x):
        return self._score(known, x)
