import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlake.llm import hard_negatives, rtree

SCHEMA = "vec_id long, embedding array<float>, label int, id string, vector string, rank string"


def brute(rows, rule=hard_negatives.Rule()):
    kept = [(i, [int(np.floor(256 * np.float64(np.float32(x)))) for x in v], (y + 1) % 10 if i is not None and i % 7 == 0 else y)
            for i, v, y in rows if y is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    lengths = [len(v) for _, v, _ in kept]
    common = max(set(lengths), key=lambda n: (lengths.count(n), n), default=0)
    kept = [r for r in kept if len(r[1]) == common]
    result = []
    for a, (anchor, v, y) in enumerate(kept):
        if anchor is None or anchor % 50:
            continue
        scored = sorted((-sum(p * q for p, q in zip(v, w)), i is None, i or 0, z == y) for b, (i, w, z) in enumerate(kept) if b != a)
        for s, none, i, _ in [r for r in scored if r[3]][:rule.positives]:
            fit = [r for r in scored if not r[3] and rule.low * -s <= 100 * -r[0] <= rule.high * -s][:rule.negatives]
            result += [(anchor, None if none else i, k + 1, None if r[1] else r[2], -s, -r[0]) for k, r in enumerate(fit)]
    return sorted(result, key=repr)


def run(spark, rows):
    given = spark.createDataFrame([(*r, "i", "v", "r") for r in rows], SCHEMA)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    found = hard_negatives.hard_negatives(given, F.col("vec_id") % 50 == 0, label)
    return sorted((tuple(r) for r in found.collect()), key=repr)


def rows_with_hard_cases():
    random.seed(9)
    centers = [[random.uniform(-1, 1) for _ in range(6)] for _ in range(10)]
    rows = [(k, [x + random.gauss(0, 0.3) for x in random.choice(centers)], random.choice([0, 1, 2, 3, None])) for k in range(1200)]
    rows += [(k, rows[100][1], 2) for k in range(2000, 2200)] + [(k, rows[100][1], 3) for k in range(2200, 2400)]  # ties
    rows += [(50, rows[50][1], 1), (50, rows[50][1], 1), (50, rows[7][1], 2), (None, rows[100][1], 1), (None, rows[100][1], 1), (-100, rows[4][1], 0)]
    rows += [(2500, None, 1), (2550, [None] * 6, 1), (2600, [float("nan")] * 6, 1), (2650, [], 1), (2700, [0.1] * 5, 1), (2750, [0.0] * 6, 1),
             (2800, rows[9][1], None), (2850, rows[9][1], 5)]
    return rows


def test_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "BLOCK", 200)
    monkeypatch.setattr(hard_negatives, "ANCHORS", 10)
    monkeypatch.setattr(rtree, "LEAF", 8)
    monkeypatch.setattr(rtree, "FANOUT", 4)
    rows = rows_with_hard_cases()
    want = brute(rows)
    assert len(want) > 50 and run(spark, rows) == want
    assert run(spark, []) == [] and run(spark, [(50, None, 1)]) == [] and run(spark, [(50, [1.0, 0.0], 1)]) == []


def test_large_components_are_an_error(spark):
    with pytest.raises(ValueError, match="at most"):
        run(spark, [(1, [1e7] * 8, 1)])


@pytest.mark.parametrize("n", [1, 63, 64, 65, 5000])
def test_boxes_bound_all_rows_below(n):
    rng = np.random.default_rng(n)
    points = rng.integers(-100, 100, (n, 7))
    order = rtree.packing_order(points)
    assert sorted(order.tolist()) == list(range(n))
    tree = rtree.tree_of(points[order])
    vectors = rng.integers(-100, 100, (3, 7)).astype(float)
    low, high = tree.intervals(vectors)

    def rows_below(node):
        own = range(tree.first[node], tree.last[node])
        return list(own) if node < tree.leaves else [r for child in own for r in rows_below(child)]

    assert sorted(rows_below(len(tree.first) - 1)) == list(range(n))
    for node in range(len(tree.first)):
        scores = vectors @ tree.points[rows_below(node)].T
        assert (low[:, node] <= scores.min(1)).all() and (scores.max(1) <= high[:, node]).all()


def test_search_passes_over_boxes():
    """Grouped rows: boxes outside of the window and boxes below the k-th best are not looked at."""
    rng = np.random.default_rng(4)
    points = (rng.integers(-1000, 1000, (40, 4))[np.repeat(np.arange(40), 128)] + rng.integers(-3, 3, (5120, 4)))
    points = points[rtree.packing_order(points)]
    tree, vector = rtree.tree_of(points), rng.integers(-100, 100, 4).astype(float)
    low, high = (x[0].tolist() for x in tree.intervals(vector[None]))
    scores = (points @ vector).astype(int)
    ids = list(range(len(points)))
    for window in [(-np.inf, np.inf), (np.quantile(scores, 0.5) // 1, np.quantile(scores, 0.6) // 1)]:
        wish = rtree.Wanted(*window, 5)
        looked = rtree.best_first(tree, vector, low, high, [wish], np.ones(len(points), bool), ids)
        want = sorted((-s, False, k) for k, s in enumerate(scores.tolist()) if window[0] <= s <= window[1])[:5]
        assert wish.found == want and looked < tree.leaves / 4
