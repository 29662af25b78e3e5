import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlake import fixtures
from flowlake.operators import knn, similarity
from flowlake.operators.evaluate import classification_report, confusion_matrix
from flowlake.operators.similarity import class_sums, cosine_to, inter_class, intra_class
from flowlake.operators.triplet import batch_loss, triplet_loss
from conftest import SF


@pytest.fixture(scope="module")
def vectors(spark):
    return fixtures.embeddings(spark, SF).repartition(4).persist()


def nearest_by_brute_force(test, train, k):
    unit = lambda f: (lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-8))(np.stack(f["v"]).astype(float))
    distance = 1 - unit(test) @ unit(train).T
    return {i: train["id"].to_numpy()[np.lexsort((train["id"], row))[:k]].tolist() for i, row in zip(test["id"], distance.round(9))}


def pivot_search(queries, known, k, block):
    index = knn.PivotIndex.of(known, known.count(), block)
    found = {r.id: [n.id for n in r.neighbours] for r in index.search(queries, k).collect()}
    return index, found


def test_neighbours_of_both_plans_equal_brute_force(vectors):
    rows = vectors.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), F.col("label").cast("string").alias("label"))
    queries, known = rows.filter("id % 5 = 0").drop("label"), rows.filter("id % 5 <> 0")
    want = nearest_by_brute_force(queries.toPandas(), known.toPandas(), 7)
    test, train = vectors.filter("vec_id % 5 = 0"), vectors.filter("vec_id % 5 <> 0")
    assert {r.id: [n.id for n in r.neighbours] for r in knn.nearest_neighbours(test, train, 7).collect()} == want
    assert {r.id: [n.id for n in r.neighbours] for r in knn.nearest_neighbours(test, train, 7, broadcast_bytes=0).collect()} == want
    assert pivot_search(queries, known, 7, 30)[1] == want
    assert pivot_search(queries, known.limit(3), 7, 30)[1].keys() == want.keys()


def test_pivots_leave_most_blocks_out(spark, monkeypatch):
    """Grouped vectors with ties, a hot vector that fills several blocks and vectors of length zero."""
    monkeypatch.setattr(knn, "TEST_ROWS", 40)  # blocks are copied for their test rows
    rng = np.random.default_rng(5)
    centers = rng.normal(size=(60, 8))
    points = centers[rng.integers(0, 60, 6000)] + 0.02 * rng.normal(size=(6000, 8))
    points[:1500] = points[0]
    points[1500:1503] = 0
    rows = spark.createDataFrame([(i, v.tolist(), str(i % 3)) for i, v in enumerate(points)], "id long, v array<double>, label string")
    queries, known = rows.filter("id % 20 = 0 OR id = 1501").drop("label"), rows.filter("id % 20 <> 0 AND id <> 1501")
    index, found = pivot_search(queries, known, 5, 60)
    assert found == nearest_by_brute_force(queries.toPandas(), known.toPandas(), 5)
    assert index.blocks.shape[0] > 60 and max(r["count"] for r in index.rows.groupBy("block").count().collect()) < 200
    homes = index.homes(queries)
    first = index.meet(homes, 5)
    bounded = homes.join(first.select("id", F.element_at("neighbours", -1)["distance"].alias("bound")), "id").filter("id > 1503")
    asked, all_pairs = index.to_meet(bounded).count(), bounded.count() * index.blocks.shape[0]
    assert asked < all_pairs / 10


def test_pairs_above_a_threshold(spark):
    """Against all pairs, with groups of near and equal vectors and vectors of length zero; few blocks are met."""
    rng = np.random.default_rng(8)
    points = rng.normal(size=(40, 6))[rng.integers(0, 40, 1500)] + 0.05 * rng.normal(size=(1500, 6))
    points[:100] = points[0]
    points[100:103] = 0
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(points)], "vec_id long, embedding array<double>")
    unit = points / np.maximum(np.linalg.norm(points, axis=1, keepdims=True), 1e-8)
    cosine = unit @ unit.T
    want = {(i, j) for i, j in zip(*np.nonzero(cosine >= 0.99)) if i < j}
    found = similarity.cosine_join(rows, 0.99, block=50).collect()
    assert len(found) == len(want) and {(r.id, r.other) for r in found} == want
    assert all(abs(r.cosine - cosine[r.id, r.other]) < 1e-9 for r in found)
    given = rows.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    index = knn.PivotIndex.of(given.withColumn("label", F.lit("")), 1500, 50)
    asked = index.to_meet(given.withColumn("bound", F.lit(0.01))).count()
    assert asked < 1500 * index.blocks.shape[0] / 3


def test_class_pairs_in_blocks_and_their_mean(spark):
    rng = np.random.default_rng(9)
    rows = [(None if k % 7 == 0 else f"c{k % 11}", rng.normal(size=4).tolist()) for k in range(200)]
    sums = class_sums(spark.createDataFrame(rows, "label string, embedding array<double>"), size=4).persist()
    one, several = (sorted(map(tuple, inter_class(sums, block=b).collect()), key=repr) for b in (512, 3))
    assert [r[:2] for r in one] == [r[:2] for r in several] and len(one) == 12 * 11 / 2
    assert [r[2] for r in one] == pytest.approx([r[2] for r in several])
    mean = similarity.mean_inter_class(sums, 4).first()[0]
    assert mean == pytest.approx(np.mean([r[2] for r in one]))
    assert similarity.mean_inter_class(sums.limit(1), 4).first()[0] is None


def test_votes_and_shares(spark):
    def near(labels):
        return [(float(i), i, name) for i, name in enumerate(labels)]
    table = spark.createDataFrame([(1, near("bbaac")), (2, near("cccba"))],
                                  "id long, neighbours array<struct<distance:double,id:long,label:string>>")
    assert {r.id: r.predicted for r in knn.predict(table).collect()} == {1: "a", 2: "c"}
    shares = {(r.id, r["class"]): r.probability for r in knn.predict_proba(table, ["a", "b", "c", "d"]).collect()}
    assert shares[(1, "a")] == 0.4 and shares[(2, "d")] == 0.0 and len(shares) == 8


def test_report_counts_zero_divisions_as_zero(spark):
    table = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "a")], "truth string, predicted string")
    rows = {r["class"]: r for r in classification_report(confusion_matrix(table)).collect()}
    assert rows["c"].precision == 0 and rows["c"].f1 == 0 and rows["accuracy"].f1 == 0.5
    assert rows["macro avg"].recall == pytest.approx(0.5)
    assert rows["weighted avg"].precision == pytest.approx((0.5 * 2 + 0.5 * 1) / 4)


def test_similarity_of_single_row_classes(vectors):
    lone = vectors.withColumn("label", F.when(F.col("vec_id") == 0, 99).otherwise(F.col("label") % 2))
    sums = class_sums(lone).persist()
    intra = {r.label: r.intra_cosine for r in intra_class(sums).collect()}
    assert intra[99] == 1.0
    frame = lone.toPandas()
    unit = np.stack(frame["embedding"]).astype(float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    for r in inter_class(sums).collect():
        a, b = (unit[(frame["label"] == c).to_numpy()] for c in (r.class_a, r.class_b))
        assert r.inter_cosine == pytest.approx((a @ b.T).mean(), abs=1e-12)


def test_triplet_loss_by_pairs():
    rng = np.random.default_rng(1)
    v = rng.normal(size=(20, 8))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    labels = rng.integers(0, 3, 20)
    losses = []
    for i in range(20):
        pos = [1 - v[i] @ v[j] for j in range(20) if j != i and labels[j] == labels[i]]
        neg = [1 - v[i] @ v[j] for j in range(20) if labels[j] != labels[i]]
        if pos and neg:
            losses.append(max(0.0, max(pos) - min(neg) + 0.3))
    assert batch_loss(v, labels) == (len(losses), pytest.approx(np.mean(losses)))
    assert batch_loss(v, np.zeros(20)) == (0, 0.0)


def test_probes_in_one_or_many_blocks(spark, monkeypatch):
    rng = np.random.default_rng(5)
    data = [(int(k), [float(x) for x in rng.normal(size=4)]) for k in range(1100)]
    vectors = spark.createDataFrame(data[:3], "vec_id long, embedding array<float>")
    probes = spark.createDataFrame(data, "vec_id long, embedding array<float>")
    whole = {(r.vec_id, r.probe): r.cosine for r in cosine_to(vectors, probes).collect()}
    assert len(whole) == 3300
    monkeypatch.setattr(similarity, "PROBE_BYTES", 20_000)
    assert {(r.vec_id, r.probe): r.cosine for r in cosine_to(vectors, probes).collect()} == whole
    unit = {k: np.float32(v).astype(float) / np.linalg.norm(np.float32(v).astype(float)) for k, v in data}
    assert all(abs(c - unit[a] @ unit[b]) < 1e-9 for (a, b), c in whole.items())


def test_batches_without_anchors_have_loss_zero(spark):
    rows = [(0, "a", [1.0, 0.0]), (0, "a", [0.0, 1.0]), (1, "a", [1.0, 0.0]), (2, "a", [1.0, 0.0]), (2, "a", [0.6, 0.8]), (2, "b", [0.0, 1.0])]
    found = triplet_loss(spark.createDataFrame(rows, "batch long, label string, embedding array<double>"), "batch")
    assert {r.batch: (r.anchors, r.loss > 0) for r in found.collect()} == {0: (0, False), 1: (0, False), 2: (2, True)}
