import hashlib
import random

import numpy as np
import pytest

from flowlake.llm import metric_tree, vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int, code string, error string, trees string"


def brute(rows):
    """Codes, errors and codebooks by the definition, in integers; ``rows`` are (id, vector, label)."""
    kept = [(i, [int(np.floor(1024 * np.float64(np.float32(x)))) for x in v], y) for i, v, y in rows
            if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    lengths = [len(v) for _, v, _ in kept]
    common = max(set(lengths), key=lambda n: (lengths.count(n), n), default=0)
    kept = [r for r in kept if len(r[1]) == common]
    width = common // 4
    cut = [[v[p * width:(p + 1) * width] for p in range(4)] for _, v, _ in kept]
    start = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, kept[k][1]))[:256]
    books = [[cut[k][p] for k in start] for p in range(4)]

    def assigned(p):
        return [min((sum((a - b) ** 2 for a, b in zip(c[p], e)), k) for k, e in enumerate(books[p])) for c in cut]

    for _ in range(4):
        for p in range(4):
            found = assigned(p)
            for k in range(len(books[p])):
                own = [c[p] for c, (_, j) in zip(cut, found) if j == k]
                if own:
                    books[p][k] = [sum(x) // len(own) for x in zip(*own)]
    last = [assigned(p) for p in range(4)]
    errors = [sum(last[p][k][0] for p in range(4)) for k in range(len(kept))]
    digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    sums = {}
    for (_, _, y), e in zip(kept, errors):
        sums[y] = sums.get(y, 0) + e
    return sorted(((i, "".join(f"{last[p][k][1]:02x}" for p in range(4)), errors[k], sums[y]) for k, (i, _, y) in enumerate(kept)), key=repr), digest


def rows_with_hard_cases():
    random.seed(5)
    centers = [[random.uniform(-1, 1) for _ in range(8)] for _ in range(12)]
    rows = [(k, [x + random.gauss(0, 0.05) for x in random.choice(centers)], random.choice([0, 1, None])) for k in range(500)]
    rows += [(k, rows[3][1], 7) for k in range(600, 900)]  # one vector many times
    rows += [(3, rows[3][1], 1), (3, rows[4][1], 1), (None, rows[5][1], 2), (None, rows[5][1], 2), (-4, rows[5][1], 2)]
    rows += [(901, None, 1), (902, [None] + [0.0] * 7, 1), (903, [float("nan")] + [0.0] * 7, 1), (904, [float("inf")] * 8, 1),
             (905, [], 1), (906, [0.5] * 4, 1), (907, [0.0] * 8, 1), (908, [-0.0003] * 8, None)]
    return rows


@pytest.fixture
def small_trees(monkeypatch):
    monkeypatch.setattr(vector_codes, "BLOCK", 128)
    monkeypatch.setattr(metric_tree, "LEAF", 8)


def run(spark, rows):
    given = spark.createDataFrame([(*r, "c", "e", "t") for r in rows], SCHEMA)
    coded, books = vector_codes.vector_codes(given)
    found = vector_codes.with_label_sums(coded)
    return sorted(((r.vec_id, r.code, r.error, r.label_error) for r in found.collect()), key=repr), vector_codes.codebooks_digest(books)


def test_codes_against_the_definition(spark, small_trees):
    rows = rows_with_hard_cases()
    assert run(spark, rows) == brute(rows)
    assert run(spark, rows[:40]) == brute(rows[:40])
    assert run(spark, [])[0] == [] and run(spark, [(1, None, 1)])[0] == []


def test_sums_of_many_labels(spark, monkeypatch):
    monkeypatch.setattr(vector_codes, "HOT_SHARE", 3)
    rows = spark.createDataFrame([(k, None if k % 2 else k % 9, k) for k in range(90)], "vec_id long, label int, error long")
    want = {}
    for r in rows.collect():
        want[r.label] = want.get(r.label, 0) + r.error
    found = vector_codes.with_label_sums(rows).collect()
    assert len(found) == 90 and all(r.label_error == want[r.label] for r in found)


def test_bounds_are_errors(spark):
    with pytest.raises(ValueError, match="equal parts"):
        run(spark, [(1, [0.1] * 6, 1)])
    with pytest.raises(ValueError, match="at most"):
        run(spark, [(1, [1e6] * 8, 1)])


@pytest.mark.parametrize("points", [
    np.random.default_rng(1).integers(-40, 40, (700, 3)), np.random.default_rng(2).integers(-2000, 2000, (900, 16)),
    np.zeros((300, 4), np.int64), np.zeros((1, 2), np.int64), np.zeros((70, 0), np.int64), np.repeat(np.arange(5), 60).reshape(-1, 1)])
def test_trees(points):
    tree = metric_tree.build(points)
    assert sorted(tree.order.tolist()) == list(range(len(points)))
    for k in range(len(tree.first)):
        own = points[tree.order[tree.first[k]:tree.end[k]]]
        assert (own.sum(0) == tree.total[k]).all()
        assert np.sqrt(((own - tree.center[k]) ** 2).sum(1)).max() <= tree.radius[k] * (1 + 1e-12) + 1e-9
    entries = points[:40]
    walk = metric_tree.nearest(tree, points, entries)
    square = ((points[:, None] - entries) ** 2).sum(2)
    found = np.full(len(points), -1)
    found[walk.points] = walk.entries
    for ball, owner in zip(walk.balls, walk.owners):
        assert (found[tree.order[tree.first[ball]:tree.end[ball]]] == -1).all()
        found[tree.order[tree.first[ball]:tree.end[ball]]] = owner
    assert (found == square.argmin(1)).all() and (square[walk.points, walk.entries] == walk.squares).all()


def test_whole_balls_are_owned():
    """Well separated groups: candidates shrink to one entry far above the leaves, so no point is looked at."""
    rng = np.random.default_rng(3)
    centers = np.array([[0, 0], [10_000, 0], [0, 10_000], [10_000, 10_000]])
    points = centers[rng.integers(0, 4, 4000)] + rng.integers(-50, 50, (4000, 2))
    walk = metric_tree.nearest(metric_tree.build(points), points, centers)
    assert len(walk.points) == 0 and len(walk.balls) < 200
