"""STR-packed R-trees over blocks of integer vectors, searched by inner product.

Sort-tile-recursive packing sorts a block on one coordinate, cuts it into slabs, and goes on in each slab with the next
coordinate; ``LEAF`` consecutive rows of the resulting order are a leaf, ``FANOUT`` consecutive nodes a node above. A
node's minimum bounding box bounds every coordinate, hence the inner product of all its rows with a given vector.
"""

from __future__ import annotations

import heapq
import math
from bisect import insort
from typing import NamedTuple

import numpy as np

LEAF = 64
FANOUT = 16


def packing_order(points: np.ndarray) -> np.ndarray:
    """The row order of STR packing; coordinates that spread widely come first."""
    coordinates = np.argsort(-points.astype(np.float64).var(0), kind="stable")
    order: list[np.ndarray] = []

    def tile(own: np.ndarray, at: int) -> None:
        pages = math.ceil(len(own) / LEAF)
        if pages <= 1 or at == len(coordinates):
            order.append(own)
            return
        slabs = math.ceil(pages ** (1 / (len(coordinates) - at)))
        rows = LEAF * math.ceil(pages / slabs)
        own = own[np.argsort(points[own, coordinates[at]], kind="stable")]
        for low in range(0, len(own), rows):
            tile(own[low:low + rows], at + 1)

    tile(np.arange(len(points)), 0)
    return np.concatenate(order)


class RTree(NamedTuple):
    """A packed tree: rows in packing order, and of all nodes, leaves first and the root last, the boxes and the range of
    the children (of a leaf: of the rows)."""
    points: np.ndarray
    low: np.ndarray
    high: np.ndarray
    first: np.ndarray
    last: np.ndarray
    leaves: int

    def intervals(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of the inner product (vectors x nodes): each coordinate gives its interval, the sums are the node's."""
        up, down = np.maximum(vectors, 0), np.minimum(vectors, 0)
        return up @ self.low.T + down @ self.high.T, up @ self.high.T + down @ self.low.T


def tree_of(points: np.ndarray) -> RTree:
    """The tree of rows that are in packing order."""
    points = points.astype(np.float64)
    at = np.arange(0, len(points), LEAF)
    lows, highs = [np.minimum.reduceat(points, at)], [np.maximum.reduceat(points, at)]
    first, last = [at], [np.append(at[1:], len(points))]
    leaves = nodes = len(at)
    below = 0
    while nodes > 1:
        at = np.arange(0, nodes, FANOUT)
        lows.append(np.minimum.reduceat(lows[-1], at))
        highs.append(np.maximum.reduceat(highs[-1], at))
        first.append(below + at)
        last.append(below + np.append(at[1:], nodes))
        below, nodes = below + nodes, len(at)
    return RTree(points, *map(np.concatenate, (lows, highs, first, last)), leaves)


class Wanted:
    """The ``most`` best rows whose score is within [low, high]: higher scores first, then smaller ids, null ids last."""
    __slots__ = ("low", "high", "most", "found")

    def __init__(self, low: float, high: float, most: int):
        self.low, self.high, self.most, self.found = low, high, most, []

    def floor(self) -> float:
        """Rows that score strictly less are of no use any more."""
        return max(self.low, -self.found[-1][0]) if len(self.found) == self.most else self.low

    def add(self, score: int, row_id: int | None) -> None:
        if self.floor() <= score <= self.high:
            insort(self.found, (-score, row_id is None, row_id or 0))
            del self.found[self.most:]


def best_first(tree: RTree, vector: np.ndarray, low: list[float], high: list[float], wanted: list[Wanted],
               usable: np.ndarray, ids: list) -> int:
    """Bring ``wanted`` up to date with the tree's usable rows and return the number of leaves looked at.

    ``low`` and ``high`` are the nodes' intervals for this vector. The queue gives the node of the highest upper bound
    first; the search ends when that is strictly below what every wish still asks for, and it passes over nodes that
    lie outside of every wish's scores.
    """
    queue = [(-high[-1], len(high) - 1)]
    floors = [w.floor() for w in wanted]
    looked = 0
    while queue:
        upper, node = heapq.heappop(queue)
        upper = -upper
        if upper < min(floors):
            break
        if not any(upper >= floor and low[node] <= w.high for floor, w in zip(floors, wanted)):
            continue
        first, last = int(tree.first[node]), int(tree.last[node])
        if node >= tree.leaves:
            for child in range(first, last):
                heapq.heappush(queue, (-high[child], child))
            continue
        looked += 1
        rows = slice(first, last)
        scores = tree.points[rows] @ vector
        near = np.flatnonzero((scores >= min(floors)) & usable[rows])
        for k in near.tolist():
            for w in wanted:
                w.add(int(scores[k]), ids[first + k])
        if len(near):
            floors = [w.floor() for w in wanted]
    return looked
