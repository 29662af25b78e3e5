import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlake.operators import knn, similarity, tiles
from flowlake.operators.evaluate import classification_report, confusion_matrix


def spread_out(spark, n, width=24, seed=3, copies=0, extra=()):
    """Vectors without near rows; the last ``copies`` are copies of the first ones, then come ``extra`` vectors."""
    points = np.random.default_rng(seed).normal(size=(n, width))
    points[n - copies:] = points[:copies]
    points = np.vstack([points, *extra])
    rows = [(i, v.tolist(), f"c{i % 3}") for i, v in enumerate(points)]
    return points, spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")


def brute_neighbours(points, test, train, k):
    unit = points / np.maximum(np.linalg.norm(points, axis=1, keepdims=True), 1e-8)
    distance = (1 - unit[test] @ unit[train].T).round(9)
    return {int(i): train[np.lexsort((train, row))[:k]].tolist() for i, row in zip(test, distance)}


@pytest.fixture
def strict(monkeypatch):
    """Pivots are judged at any size; blocks are small."""
    monkeypatch.setattr(knn, "FEW_MEETINGS", 0)
    monkeypatch.setattr(tiles, "BLOCK_ROWS", 64)
    monkeypatch.setattr(tiles, "SIDE_BYTES", 16_000)


def split_of(table):
    return table.filter("vec_id % 4 = 0"), table.filter("vec_id % 4 <> 0")


def found_by(table, k, **more):
    return knn.nearest_neighbours(*split_of(table), k, **more)


def test_search_beside_a_large_table_keeps_to_a_tile():
    rng = np.random.default_rng(1)
    test, train = tiles.unit(rng.normal(size=512 * 16), 512), tiles.unit(rng.normal(size=100_000 * 16), 100_000)
    ids, labels = np.arange(100_000), np.full(100_000, "a", object)
    tracemalloc.start()
    try:
        batch = knn._neighbour_arrays(knn.pa.array(np.arange(512)), test, train, ids, labels, 7)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 100e6
    want = np.argsort(1 - test @ train.T, axis=1)[:, :7]
    assert [[n["id"] for n in row] for row in batch.column("neighbours").to_pylist()] == want.tolist()


def test_votes_of_far_vectors_meet_tile_by_tile(spark, strict):
    """Ties, vectors of length zero, more neighbours than a block has rows."""
    points, table = spread_out(spark, 900, copies=300, extra=[np.zeros((5, 24))])
    ids = np.arange(len(points))
    for k in (7, 70):
        found = found_by(table, k, broadcast_bytes=0)
        assert "CartesianProduct" in found._jdf.queryExecution().executedPlan().toString()
        assert {r.id: [n.id for n in r.neighbours] for r in found.collect()} == brute_neighbours(points, ids[ids % 4 == 0], ids[ids % 4 != 0], k)


def test_rows_that_share_an_id_stay_rows(spark, strict):
    points, table = spread_out(spark, 400)
    twice = table.unionByName(table.filter("vec_id < 40"))
    by_broadcast, by_tiles = (sorted((r.id, [(n.id, n.label) for n in r.neighbours]) for r in found_by(twice, 5, broadcast_bytes=b).collect()) for b in (1 << 30, 0))
    assert by_tiles == by_broadcast and len(by_tiles) == 110


def test_shares_of_votes_are_whole_by_tiles(spark, strict):
    points, table = spread_out(spark, 500)
    near = [knn.predict_proba(found_by(table, 7, broadcast_bytes=b), ["c0", "c1", "c2"]) for b in (1 << 30, 0)]
    one, other = (sorted(map(tuple, n.collect())) for n in near)
    assert one == other and len(one) == 125 * 3


def judged(table, broadcast_bytes):
    truth = table.select(F.col("vec_id").alias("id"), F.col("label").alias("truth"))
    return confusion_matrix(knn.predict(found_by(table, 7, broadcast_bytes=broadcast_bytes)).join(truth, "id"))


def test_confusion_counts_every_test_row_by_tiles(spark, strict):
    points, table = spread_out(spark, 600, copies=200)
    one, other = (sorted(map(tuple, judged(table, b).collect())) for b in (1 << 30, 0))
    assert one == other and sum(n for *_, n in one) == 150


def test_report_is_the_same_by_tiles(spark, strict):
    points, table = spread_out(spark, 600, seed=4)
    one, other = (sorted(map(tuple, classification_report(judged(table, b)).collect())) for b in (1 << 30, 0))
    assert one == other and len(one) == 6


def test_near_vectors_are_still_found_by_pivots(spark, strict):
    rng = np.random.default_rng(7)
    points = rng.normal(size=(60, 12))[rng.integers(0, 60, 3000)] + 0.02 * rng.normal(size=(3000, 12))
    table = spark.createDataFrame([(i, v.tolist(), "a") for i, v in enumerate(points)], "vec_id long, embedding array<double>, label string")
    found = found_by(table, 5, broadcast_bytes=0)
    assert "CartesianProduct" not in found._jdf.queryExecution().executedPlan().toString()
    ids = np.arange(3000)
    assert {r.id: {n.id for n in r.neighbours} for r in found.collect()} == {
        i: set(n) for i, n in brute_neighbours(points, ids[ids % 4 == 0], ids[ids % 4 != 0], 5).items()}


def test_meetings_leave_a_task_in_bounded_batches(spark, monkeypatch):
    monkeypatch.setattr(knn, "_BATCH", 50)
    points, table = spread_out(spark, 1000)
    known = table.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")
    index = knn.PivotIndex.of(known, 1000, 30)
    sent = []
    monkeypatch.setattr(type(known), "mapInArrow", lambda self, look, schema: sent.append(look))
    index.to_meet(known.select("id", "v").withColumn("bound", F.lit(2.0)))
    given = knn.pa.RecordBatch.from_pydict({"id": list(range(1000)), "v": points.tolist(), "bound": [2.0] * 1000})
    batches = [b.num_rows for b in sent[0](iter([given]))]
    assert sum(batches) == 1000 * index.blocks.shape[0] and max(batches) <= 50


def test_pairs_of_far_vectors_meet_tile_by_tile(spark, strict):
    points, table = spread_out(spark, 700, copies=100, extra=[np.zeros((3, 24))])
    repeated = table.unionByName(table.filter("vec_id < 20"))
    unit = points / np.maximum(np.linalg.norm(points, axis=1, keepdims=True), 1e-8)
    cosine = unit @ unit.T
    times = np.where(np.arange(len(points)) < 20, 2, 1)
    want = sorted((int(i), int(j)) for i, j in zip(*np.nonzero(cosine >= 0.35)) if i < j for _ in range(times[i] * times[j]))
    joined = similarity.cosine_join(repeated, 0.35)
    assert "CartesianProduct" in joined._jdf.queryExecution().executedPlan().toString()
    found = joined.collect()
    assert sorted((r.id, r.other) for r in found) == want
    assert all(abs(r.cosine - cosine[r.id, r.other]) < 1e-9 for r in found)


def test_pairs_of_a_common_vector_come_in_bounded_batches():
    same = tiles.unit(np.ones(3000 * 8), 3000)
    sizes = [len(row) for row, _, _ in tiles.close(same, same, 0.5)]
    assert sum(sizes) == 9_000_000 and max(sizes) <= tiles._PAIRS
