"""Metric trees by the anchors hierarchy, with cached sums, over one block of integer points.

Anchors are chosen one after the other, each the point farthest from the anchor of the largest ball; it takes the
points that are nearer to it, and the triangle inequality tells which anchors' points need not be looked at. The
about sqrt(n) anchors are joined pairwise into one tree, the pair with the smallest common ball first, and are then
divided in the same way: the tree grows from its middle outwards. Every ball knows its centroid, a radius around all
its points, their number and their vector sum; its points are a range of the tree's order.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

#: Balls of at most this many points are not divided.
LEAF = 64
#: Rounding allowance of distances, relative to their size: bounds give way by it, so they never cut too much.
SLACK = 1e-12


class MetricTree(NamedTuple):
    """Order of the points and, by ball: range in the order, children (-1: none), centroid, radius and vector sum.

    Children come before their parent; the last ball is the root.
    """
    order: np.ndarray
    first: np.ndarray
    end: np.ndarray
    left: np.ndarray
    right: np.ndarray
    center: np.ndarray
    radius: np.ndarray
    total: np.ndarray


def anchors(points: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """(owner of every point, anchor points): up to ``count`` anchors, fewer if all points sit on one."""
    chosen = np.zeros(1, np.int64)
    owner = np.zeros(len(points), np.int64)
    reach = np.sqrt(((points - points[0]) ** 2).sum(1))
    while len(chosen) < count:
        widest = int(reach.argmax())
        if reach[widest] == 0:
            break
        between = np.sqrt(((points[chosen] - points[widest]) ** 2).sum(1))
        open_to = np.flatnonzero(reach * 2 > between[owner])  # nearer than half way to the new anchor: stays
        away = np.sqrt(((points[open_to] - points[widest]) ** 2).sum(1))
        taken = away < reach[open_to]
        owner[open_to[taken]], reach[open_to[taken]] = len(chosen), away[taken]
        chosen = np.append(chosen, widest)
    return owner, chosen


def _joined(centers: np.ndarray, radii: np.ndarray, sizes: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of balls in the order of joining; the k-th pair becomes ball ``len(centers) + k``."""
    count = len(centers)
    center, radius, size = (np.zeros((2 * count - 1, *a.shape[1:])) for a in (centers, radii, sizes))
    center[:count], radius[:count], size[:count] = centers, radii, sizes
    cost = np.full((2 * count - 1, 2 * count - 1), np.inf)

    def common(a: int, others: np.ndarray) -> np.ndarray:
        apart = np.sqrt(((center[others] - center[a]) ** 2).sum(1))
        return np.maximum((apart + radius[a] + radius[others]) / 2, np.maximum(radius[a], radius[others]))

    for a in range(1, count):
        cost[a, :a] = common(a, np.arange(a))
    alive, pairs = np.arange(count), []
    for new in range(count, 2 * count - 1):
        a, b = np.unravel_index(int(cost[:new, :new].argmin()), (new, new))
        size[new] = size[a] + size[b]
        center[new] = (center[a] * size[a] + center[b] * size[b]) / size[new]
        radius[new] = max(np.sqrt(((center[k] - center[new]) ** 2).sum()) + radius[k] for k in (a, b))
        for gone in (a, b):
            cost[gone, :], cost[:, gone] = np.inf, np.inf
        alive = alive[(alive != a) & (alive != b)]
        cost[new, alive] = common(new, alive)
        alive = np.append(alive, new)
        pairs.append((int(a), int(b)))
    return pairs


def build(points: np.ndarray) -> MetricTree:
    """The tree of ``points`` (n x d integers, n > 0)."""
    plain = points.astype(np.float64)
    order = np.empty(len(points), np.int64)
    balls: list[tuple] = []
    placed = 0

    def add(low: int, left: int, right: int, total: np.ndarray) -> int:
        center = total / (placed - low)
        radius = np.sqrt(((plain[order[low:placed]] - center) ** 2).sum(1).max())
        balls.append((low, placed, left, right, center, radius, total))
        return len(balls) - 1

    def leaf(own: np.ndarray) -> int:
        nonlocal placed
        low, placed = placed, placed + len(own)
        order[low:placed] = own
        return add(low, -1, -1, points[own].sum(0))

    def divided(own: np.ndarray) -> int:
        if len(own) <= LEAF:
            return leaf(own)
        owner, chosen = anchors(plain[own], int(np.ceil(np.sqrt(len(own)))))
        if len(chosen) == 1:
            return leaf(own)  # all points are the same
        groups = [own[owner == k] for k in range(len(chosen))]
        centers = np.stack([plain[g].mean(0) for g in groups])
        radii = np.array([np.sqrt(((plain[g] - c) ** 2).sum(1).max()) for g, c in zip(groups, centers)])
        pairs = _joined(centers, radii, np.array([len(g) for g in groups]))

        def grown(k: int) -> int:
            if k < len(groups):
                return divided(groups[k])
            low = placed
            left, right = (grown(child) for child in pairs[k - len(groups)])
            return add(low, left, right, balls[left][6] + balls[right][6])
        return grown(len(groups) + len(pairs) - 1)

    divided(np.arange(len(points)))
    first, end, left, right, center, radius, total = zip(*balls)
    return MetricTree(order, *(np.array(a, np.int64) for a in (first, end, left, right)), np.stack(center),
                      np.array(radius), np.stack(total))


class Walk(NamedTuple):
    """What a walk found: balls that one entry owns whole and those entries, then the points of the other leaves, their
    entries and squared distances."""
    balls: np.ndarray
    owners: np.ndarray
    points: np.ndarray
    entries: np.ndarray
    squares: np.ndarray


def nearest(tree: MetricTree, points: np.ndarray, entries: np.ndarray) -> Walk:
    """The nearest of ``entries`` for all points, ties to the lower index.

    The walk goes down level by level. A ball inherits its parent's candidates and drops those that are farther from
    each of its points than another one is. With one left, that entry owns the ball and its points are not looked at;
    in a leaf, the points are compared with what is left. Squared distances are integers below 2^53, so they are exact.
    """
    plain, at = entries.astype(np.float64), points.astype(np.float64)
    own_square = (plain ** 2).sum(1)
    level = np.array([len(tree.first) - 1])
    candidates = np.ones((1, len(entries)), bool)
    balls, owners, found = [], [], []
    while len(level):
        center, radius = tree.center[level], tree.radius[level][:, None]
        square = (center ** 2).sum(1)[:, None] - 2 * center @ plain.T + own_square
        scale = (center ** 2).sum(1)[:, None] + own_square
        allowed = np.sqrt(SLACK * scale) + SLACK * radius
        apart = np.where(candidates, np.sqrt(np.maximum(square, 0)), np.inf)
        farthest = (apart + allowed).min(1)[:, None] + radius
        candidates = apart - allowed - radius <= farthest
        single = candidates.sum(1) == 1
        balls.append(level[single])
        owners.append(candidates[single].argmax(1))
        is_leaf = tree.left[level] < 0
        for k in np.flatnonzero(is_leaf & ~single).tolist():
            own = tree.order[tree.first[level[k]]:tree.end[level[k]]]
            left = np.flatnonzero(candidates[k])
            away = (at[own] ** 2).sum(1)[:, None] - 2 * at[own] @ plain[left].T + own_square[left]
            best = away.argmin(1)
            found.append((own, left[best], away[np.arange(len(own)), best]))
        down = ~is_leaf & ~single
        level, candidates = np.concatenate([tree.left[level[down]], tree.right[level[down]]]), np.concatenate([candidates[down]] * 2)
    parts = [np.concatenate(p) if p else np.zeros(0) for p in zip(*found)] or [np.zeros(0)] * 3
    return Walk(np.concatenate(balls), np.concatenate(owners), *(p.astype(np.int64) for p in parts))
