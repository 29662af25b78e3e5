import numpy as np
import pytest
from pyspark.sql import functions as F

from brute import Brute
from flowlake.operators import subspace
from flowlake.operators.baseline import FlowBaseline, FlowBaselineModel, clipped_contamination
from flowlake.operators.features import add_context_key, add_features
from flowlake.operators.scoring import risk_band
from flowlake.schema import TRAFFIC_CLASSES
from flowlake.session import scratch_path


@pytest.fixture(scope="module")
def fitted(flows):
    return FlowBaseline().fit(flows)


def test_fit_matches_brute_force(fitted, flows, flow_frame):
    brute = Brute(flow_frame)
    assert fitted.thresholds[None] == pytest.approx(brute.threshold, rel=1e-9)
    np.testing.assert_allclose(np.abs(fitted.components[None] @ brute.directions.T), np.eye(4), atol=1e-8)
    table = fitted.add_scores(add_features(add_context_key(flows))).toPandas().set_index("flow_id")
    table = table.loc[flow_frame["flow_id"]]
    distance, rest, rarity = brute.parts(flow_frame)
    np.testing.assert_allclose(table["distance"], distance, atol=1e-9)
    np.testing.assert_allclose(table["reconstruction"], rest, atol=1e-6)
    np.testing.assert_allclose(table["rarity"], rarity, atol=1e-9)
    np.testing.assert_allclose(table["anomaly_score"], brute.scores(flow_frame), atol=1e-6)


def test_transform_of_other_rows(fitted, flows, flow_frame):
    part, frame = flows.filter("flow_id % 3 = 0"), flow_frame[flow_frame.flow_id % 3 == 0]
    result = fitted.transform(part).toPandas().set_index("flow_id").loc[frame["flow_id"]]
    brute = Brute(flow_frame)
    scores = brute.scores(frame)
    limit = brute.decide(frame, scores, brute.threshold)
    assert fitted.scoring_thresholds[None] == pytest.approx(limit, rel=1e-9)
    assert (result["is_anomaly"].to_numpy() == (scores >= limit - 1e-9)).all()
    assert set(result["traffic_class"]) <= set(TRAFFIC_CLASSES)
    assert (result["traffic_class"] == "BENIGN").equals(~result["is_anomaly"])


def test_fit_transform_equals_fit_then_transform(fitted, flows):
    a = FlowBaseline().fit_transform(flows).select("flow_id", "is_anomaly", "traffic_class", "explanation")
    b = fitted.transform(flows).select(*a.columns)
    assert a.exceptAll(b).count() == 0


def test_partitioning_does_not_matter(fitted, flows):
    other = FlowBaseline().fit(flows.repartition(13, "src_ip"))
    assert other.thresholds[None] == pytest.approx(fitted.thresholds[None], rel=1e-9)


def test_per_source_equals_separate_models(flows, flow_frame):
    joint = FlowBaseline(by="dataset_source")
    result = joint.fit_transform(flows).toPandas().set_index("flow_id")
    for source, frame in flow_frame.groupby("dataset_source"):
        brute = Brute(frame)
        assert joint.model.thresholds[source] == pytest.approx(brute.threshold, rel=1e-9)
        np.testing.assert_allclose(result.loc[frame["flow_id"], "anomaly_score"], brute.scores(frame), atol=1e-6)


def test_merged_factors_keep_the_gram_matrix(spark, flows, monkeypatch):
    monkeypatch.setattr(subspace, "_DRIVER_FACTORS", 0)
    table = add_features(flows).repartition(7)
    vector = [F.col("f_log_bytes"), F.col("f_bytes_per_packet"), F.col("f_is_tcp") * 1e6]
    matrix = np.array([list(r) for r in table.select(*vector).collect()])
    r = subspace.merged_factors(table, vector, None, 7)[None]
    np.testing.assert_allclose(r.T @ r, matrix.T @ matrix, rtol=1e-9)
    grouped = subspace.merged_factors(table, vector, "dataset_source", 7, 3)
    np.testing.assert_allclose(sum(g.T @ g for g in grouped.values()), matrix.T @ matrix, rtol=1e-9)


def test_save_and_load(spark, fitted, flows, tmp_path):
    fitted.save(str(tmp_path / "model"))
    loaded = FlowBaselineModel.load(spark, str(tmp_path / "model"))
    a, b = (m.transform(flows).select("flow_id", F.round("anomaly_score", 9), "explanation") for m in (fitted, loaded))
    assert a.exceptAll(b).count() == 0
    grouped = FlowBaseline(by="dataset_source").fit(flows)
    grouped.save(str(tmp_path / "grouped"))
    assert FlowBaselineModel.load(spark, str(tmp_path / "grouped")).thresholds == grouped.thresholds


def test_unlabelled_flows_and_unseen_contexts(fitted, flows):
    row = fitted.add_scores(add_features(add_context_key(
        flows.limit(1).withColumn("direction", F.lit("sideways"))))).first()
    assert row["rarity"] == pytest.approx(9.210340, abs=1e-6)
    model = FlowBaseline().fit(flows.drop("label"))
    assert model.transform(flows.drop("label")).filter("is_anomaly").count() >= 1


def test_empty_input_is_an_error(flows):
    with pytest.raises(ValueError):
        FlowBaseline().fit(flows.limit(0))


def test_small_rules(spark):
    assert [clipped_contamination(v) for v in (0, 0.9, 0.08)] == [0.01, 0.35, 0.08]
    table = spark.createDataFrame([(v,) for v in (18.0, 17.99, 12.0, 7.0, 6.99)], "v double")
    assert [r[0] for r in table.select(risk_band(F.col("v"))).collect()] == [
        "critical", "high", "high", "medium", "low"]


def test_null_features_are_refused_with_their_number(flows):
    broken = flows.withColumn("dst_port", F.when(F.col("flow_id") >= 3, F.col("dst_port")))
    with pytest.raises(ValueError, match="^3 flows"):
        FlowBaseline(rank=0).fit(broken)


@pytest.mark.parametrize("kind", ["boolean", "double", "date"])
def test_typed_group_keys(spark, flows, kind):
    key = {"boolean": F.col("flow_id") % 2 == 0, "double": (F.col("flow_id") % 2).cast("double"),
           "date": F.date_add(F.lit("2024-01-01").cast("date"), (F.col("flow_id") % 2).cast("int"))}[kind]
    keyed = flows.withColumn("part", key)
    estimator = FlowBaseline(by="part")
    scored = estimator.fit_transform(keyed)
    path = scratch_path(spark, "model")
    estimator.model.save(path)
    again = FlowBaselineModel.load(spark, path)
    assert again.thresholds == estimator.model.thresholds and len(again.thresholds) == 2
    assert scored.filter("anomaly_score IS NULL").count() == 0
