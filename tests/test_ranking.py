from pyspark.sql import functions as F

from flowlake.operators.positions import assign_batches, time_order, with_position
from flowlake.operators.ranking import benign_reference, best_per_signature, latest_rows, limit_rows, top_hits
from flowlake.operators.reports import summary_cards, top_hit_rows
from flowlake.operators import resample
from flowlake.operators.resample import balanced_resample, label_index, stratified_split
from flowlake.operators.summary import summarize


def scored(flows):
    return flows.withColumns({"anomaly_score": F.col("bytes"), "is_anomaly": F.col("bytes") > 30000,
                              "risk_level": F.lit("low"), "traffic_class": F.lit("BENIGN"),
                              "explanation": F.lit("x")})


def test_top_hits(flows):
    table = scored(flows)
    quick = top_hits(table, 5)
    # one signature holds most rows
    hot = table.withColumns({c: F.when(F.col("bytes") > 100, F.lit("1")).otherwise(F.col(c)) for c in ("src_ip", "dst_ip")})
    hot = hot.withColumns({"dst_port": F.lit(1), "protocol": F.lit("TCP")})
    rows = top_hits(hot, 3).collect()
    frame = hot.toPandas().sort_values(["anomaly_score", "flow_id"], ascending=[False, True])
    want = frame.drop_duplicates(["src_ip", "dst_ip", "dst_port", "protocol"]).head(3)
    assert [r.flow_id for r in rows] == want["flow_id"].tolist()
    frame = table.toPandas().sort_values(["anomaly_score", "flow_id"], ascending=[False, True])
    want = frame.drop_duplicates(["src_ip", "dst_ip", "dst_port", "protocol"]).head(5)
    assert [r.flow_id for r in quick.collect()] == want["flow_id"].tolist()


def test_limit_rows(flows):
    assert limit_rows(flows, None, "flow_id").count() == flows.count()
    assert limit_rows(flows, 10 ** 6, "flow_id").count() == flows.count()
    a, b = (limit_rows(t, 123, "flow_id") for t in (flows, flows.repartition(9)))
    assert a.count() == 123 and a.exceptAll(b).count() == 0


def test_positions_with_null_and_equal_times(flows):
    ties = flows.withColumn("timestamp", F.when(F.col("flow_id") % 3 == 0, None).otherwise(
        F.lit("2024-01-01").cast("timestamp")))
    placed = with_position(ties, time_order("flow_id")).select("flow_id", "position").toPandas()
    frame = ties.toPandas().sort_values(["timestamp", "flow_id"], na_position="last")
    assert placed.set_index("flow_id").loc[frame["flow_id"], "position"].tolist() == list(range(len(frame)))
    batches = assign_batches(flows, 10, "flow_id").groupBy("slice_id").count().collect()
    assert max(r["count"] for r in batches) == 100      # batches hold 100 rows at least


def test_benign_reference_rules(flows):
    few = flows.withColumn("label", F.when(F.col("flow_id") < 100, "normal").otherwise("ddos"))
    assert benign_reference(few, True).count() == flows.count()
    assert benign_reference(few, False).count() == 0
    assert benign_reference(flows.drop("label")).count() == flows.count()
    assert benign_reference(scored(few)).count() == 100          # the pool holds the normals only
    mixed = scored(few.withColumn("label", F.when(F.col("flow_id") < 400, F.lit("unknown")).otherwise(F.col("label")))
                   .withColumn("label", F.when(F.col("flow_id") < 100, "normal").otherwise(F.col("label"))))
    assert 100 < benign_reference(mixed).count() <= 250
    flagged = scored(flows.drop("label"))
    assert benign_reference(flagged, exclude_flagged=True).count() == flagged.filter("NOT is_anomaly").count()


def test_split_and_resample(flows):
    split = stratified_split(flows, "protocol", "flow_id")
    rows = split.groupBy("protocol").agg(F.count("*").alias("n"), F.count_if("is_test").alias("t")).collect()
    assert all(r.t == -(-r.n * 2 // 10) for r in rows)
    drawn = balanced_resample(flows, "label", "flow_id").groupBy("label").count().collect()
    assert all(abs(r["count"] - 1000 / 3) < 40 for r in drawn)
    lone = flows.withColumn("label", F.when(F.col("flow_id") == 0, "lone").otherwise("rest"))
    assert stratified_split(lone, "label", "flow_id").filter("is_test").count() == 200
    many = balanced_resample(lone, "label", "flow_id", draws=60_000).groupBy("label").count().collect()
    counts = {r["label"]: r["count"] for r in many}
    assert sum(counts.values()) == 60_000 and abs(counts["lone"] - 30_000) < 5 * (60_000 / 4) ** 0.5


def test_draws_are_multinomial(spark):
    """Exactly n draws; classes and the rows of a class come equally often, as a chi-square test finds."""
    table = spark.createDataFrame([(k, "a" if k < 60 else "b" if k < 90 else None) for k in range(100)], "flow_id long, label string")
    drawn = balanced_resample(table, "label", "flow_id", draws=9000).collect()
    assert len(drawn) == 9000 and len({(r.flow_id, r.draw) for r in drawn}) == 9000
    counts = {k: 0 for k in range(100)}
    for r in drawn:
        counts[r.flow_id] += 1

    def chi_square(parts):
        return sum((seen - sum(parts) / len(parts)) ** 2 / (sum(parts) / len(parts)) for seen in parts)

    ids = [range(60), range(60, 90), range(90, 100)]
    assert chi_square([sum(counts[k] for k in own) for own in ids]) < 14  # 2 degrees of freedom, one in a thousand
    assert all(chi_square([counts[k] for k in own]) < bound for own, bound in zip(ids, (99, 58, 28)))
    assert sorted(balanced_resample(table, "label", "flow_id", draws=9000).collect()) == sorted(drawn)
    empty = balanced_resample(table.filter("false"), "label", "flow_id")
    assert empty.count() == 0 and empty.columns == ["flow_id", "label", "draw"]


def test_split_of_many_classes(spark, monkeypatch):
    table = spark.createDataFrame([(k, None if k % 5 == 0 else f"c{k % 7}") for k in range(400)], "flow_id long, label string")
    few = sorted(stratified_split(table, "label", "flow_id").collect())
    monkeypatch.setattr(resample, "COUNTED_CLASSES", 1)
    many = stratified_split(table, "label", "flow_id")
    assert sorted(many.collect()) == few and many.columns == ["flow_id", "label", "is_test"] and 80 <= sum(r.is_test for r in few) <= 88


def test_missing_labels_and_empty_tables(spark):
    table = spark.createDataFrame([(1, "b"), (2, None), (3, "a"), (4, "b")], "flow_id long, label string")
    assert {r.flow_id: r.label_index for r in label_index(table, "label").collect()} == {1: 1, 2: None, 3: 0, 4: 1}
    assert stratified_split(table.filter("false"), "label", "flow_id").select("is_test").collect() == []


def test_summary_without_labels_or_denominators(flows):
    row = summarize(scored(flows.drop("label"))).first().asDict()
    assert "known_attack_flows" not in row and row["total_flows"] == flows.count()
    row = summarize(scored(flows.withColumn("label", F.lit("normal")))).first()
    assert row.detected_known_attacks is None and row.known_attack_recall is None
    assert summarize(scored(flows).limit(0)).first().top_protocol == "N/A"


def test_report_rows(flows):
    rows = top_hit_rows(scored(flows).drop("dataset_source"), 2).collect()
    assert rows[0].dataset_source == "local" and "/" in rows[0].service and rows[0].score.count(".") == 1
    cards = {r.card: r.value for r in summary_cards(summarize(scored(flows))).collect()}
    assert cards["Total Flows"] == str(flows.count())


def test_best_per_signature_with_text_keys_and_null_scores(spark):
    rows = [("a", "k2", 5.0), ("a", "k1", 5.0), ("a", "k0", None), ("b", "k3", None), (None, "k4", 1.0)]
    table = spark.createDataFrame(rows, "src_ip string, flow_id string, anomaly_score double")
    found = best_per_signature(table, ["src_ip"], "flow_id").collect()
    assert {(r.src_ip, r.flow_id, r.anomaly_score) for r in found} == {("a", "k1", 5.0), ("b", "k3", None), (None, "k4", 1.0)}
    assert [r.flow_id for r in top_hits(table, 2).collect()] == ["k1", "k4"]


def test_latest_rows_with_null_and_equal_times(flows):
    table = flows.withColumn("timestamp", F.when(F.col("flow_id") % 50 == 0, None).when(F.col("flow_id") % 3 == 0, F.lit("2024-01-20").cast("timestamp"))
                             .otherwise(F.col("timestamp")))
    frame = table.select("timestamp", "flow_id").toPandas().sort_values(["timestamp", "flow_id"], na_position="last")
    for count in (1, 13, 25, 300, 500, 999, 1000, 5000):
        assert sorted(r.flow_id for r in latest_rows(table, count).collect()) == sorted(frame["flow_id"].tail(count))
