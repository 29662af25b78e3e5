import numpy as np
import pytest
from pyspark.sql import functions as F

from brute import adaptive
from flowlake.plans.adaptive import AdaptiveSettings, adaptive_per_source, adaptive_run, combined_summary, latest_by_position
from flowlake.session import scratch_path
from flowlake.sources.sinks import write_batch_summary
from flowlake.streaming.adaptive_stream import finish_warmup, first_deliveries, score_available, start_adaptive_stream

SETTINGS = AdaptiveSettings(batch_size=350, memory_size=500)


@pytest.fixture(scope="module")
def run(flows):
    return adaptive_run(flows, SETTINGS)


def test_run_equals_brute_force(run, flow_frame):
    scored = run.scored().toPandas().set_index("flow_id")
    parts, log = adaptive(flow_frame, 350, 500)
    for number, (ids, scores, flags) in enumerate(parts, start=1):
        got = scored.loc[ids]
        assert (got["batch_id"] == number).all()
        np.testing.assert_allclose(got["anomaly_score"], scores, atol=1e-5)
        assert (got["is_anomaly"].to_numpy() == flags).all()
    summaries = run.batch_summaries().orderBy("batch_id").collect()
    assert [(r.batch_id, r.relearn_status) for r in summaries] == [(n, s) for n, _, s in log]
    assert [r.threshold for r in summaries] == pytest.approx([t for _, t, _ in log], abs=1e-3)


def test_summary(run, flow_frame):
    row = run.summary().first()
    assert (row.adaptive_batches, row.warmup_batches, row.memory_size, row.total_flows) == (3, 1, 500, len(flow_frame))
    assert row.final_threshold == run.logged(3).threshold
    counts = {r.traffic_class: r["count"] for r in run.scored().groupBy("traffic_class").count().collect()}
    assert run.summary(with_classes=True).first().class_breakdown == counts


def test_batch_summary_as_csv(spark, run, tmp_path):
    write_batch_summary(run.batch_summaries(), str(tmp_path / "out"))
    rows = spark.read.option("header", True).csv(str(tmp_path / "out")).collect()
    assert [r.batch_id for r in rows] == ["1", "2", "3"] and rows[0].phase == "warmup"


def test_few_normals_skip_relearning(flows):
    late = flows.withColumn("label", F.when(F.col("flow_id") < 500, F.col("label")).otherwise("ddos"))
    learner = adaptive_run(late, AdaptiveSettings(batch_size=500))
    statuses = [r.relearn_status for r in learner.batch_summaries().orderBy("batch_id").collect()]
    assert statuses[0] == "warmup" and len(statuses) == 2
    # no normal row in the second batch: the unflagged rows stand in
    assert learner.logged(2).candidates == learner.scored().filter("batch_id = 2 AND NOT is_anomaly").count()


def test_sources_side_by_side(flows):
    scored, summaries = adaptive_per_source(flows, AdaptiveSettings(batch_size=200), parallel=3)
    assert scored.count() == flows.count()
    rows = summaries.collect()
    assert {r.dataset_source for r in rows} == {"shop", "office", "branch"}
    row = combined_summary(scored, summaries).first()
    last = {r.dataset_source: r.threshold for r in sorted(rows, key=lambda r: r.batch_id)}
    assert row.per_source_thresholds == ", ".join(f"{k}={last[k]}" for k in sorted(last)) and row.total_flows == flows.count()


def test_stream_equals_batch(spark, flows, run, flow_frame):
    root = scratch_path(spark, "stream-test")
    ids = flow_frame["flow_id"].tolist()
    schema = flows.schema
    jobs = None
    for i in range(3):
        # one file per slice; a query run per file keeps the files in time order
        part = flows.filter(F.col("flow_id").isin(ids[i * 350:(i + 1) * 350]))
        part = part.unionByName(part.limit(5)) if i == 1 else part          # a few flows are sent twice
        part.coalesce(1).write.mode("append").parquet(f"{root}/input")
        stream = spark.readStream.schema(schema).parquet(f"{root}/input")
        jobs = start_adaptive_stream(stream, f"{root}/run", SETTINGS)
        jobs.awaitTermination()
    got = spark.read.parquet(f"{root}/run/scored").filter("learning_phase IS NOT NULL")
    want = run.scored()
    join = got.alias("g").join(want.alias("w"), "flow_id")
    assert got.count() == want.count() == len(ids)
    assert join.filter("abs(g.anomaly_score - w.anomaly_score) > 1e-6 OR g.is_anomaly <> w.is_anomaly "
                       "OR g.batch_id <> w.batch_id").count() == 0


def test_late_and_untimed_flows_are_scored(spark, flows):
    """A flow that arrives hours late, one without a time, and one that was sent before."""
    root = scratch_path(spark, "late-test")
    first = flows.orderBy(F.desc("timestamp")).limit(300)
    late = flows.join(first, "flow_id", "left_anti").select(flows.columns).orderBy("timestamp").limit(100)
    untimed = late.limit(1).withColumn("flow_id", F.lit(10 ** 6).cast(flows.schema["flow_id"].dataType)).withColumn(
        "timestamp", F.lit(None).cast("timestamp"))
    for part in (first, late.unionByName(untimed).unionByName(first.limit(7))):
        part.coalesce(1).write.mode("append").parquet(f"{root}/input")
        stream = spark.readStream.schema(flows.schema).parquet(f"{root}/input")
        start_adaptive_stream(stream, f"{root}/run", SETTINGS).awaitTermination()
    assert spark.read.parquet(f"{root}/run/scored").count() == 401


def test_latest_rows_at_high_slice_numbers(spark):
    for low in (2 ** 13, 2 ** 17, 2 ** 24):
        rows = spark.range(1000).select((F.col("id") % 10 + low).alias("slice_id"), F.floor(F.col("id") / 10).alias("position"))
        kept = latest_by_position(rows, 130, 1000).collect()
        want = sorted(((s + low, p) for s in range(10) for p in range(100)), reverse=True)[:130]
        assert sorted(((r.slice_id, r.position) for r in kept), reverse=True) == want


def test_warmup_is_counted_in_slices_there_are(flows):
    learner = adaptive_run(flows, AdaptiveSettings(batch_size=500, warmup_batches=9))
    assert learner.summary().first().warmup_batches == 2


def test_first_deliveries_over_many_micro_batches(spark):
    """Fifty micro-batches, each with flows of earlier ones and rows without a key; then keys that are let go."""
    root = scratch_path(spark, "deliveries")
    rows = [(k // 4, k if k % 4 < 3 else k // 2 if k % 8 < 7 else None) for k in range(200)]
    for number in range(50):
        part = spark.createDataFrame([r for r in rows if r[0] == number], "delivery long, flow_id long")
        part.coalesce(1).write.parquet(f"{root}/input/n={number:02d}")
    stream = (spark.readStream.schema("delivery long, flow_id long").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true")
              .parquet(f"{root}/input"))
    query = first_deliveries(stream, "flow_id").writeStream.format("parquet").option("path", f"{root}/out").option(
        "checkpointLocation", f"{root}/offsets").trigger(availableNow=True).start()
    query.awaitTermination()
    assert query.lastProgress["batchId"] >= 49
    # the state knows each key and each row without one, once
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] == len({k for _, k in rows if k is not None}) + sum(k is None for _, k in rows)
    found = [r.flow_id for r in spark.read.parquet(f"{root}/out").collect()]
    assert sorted(found, key=repr) == sorted([*{k for _, k in rows if k is not None}, *[k for _, k in rows if k is None]], key=repr)

    forgetful = first_deliveries(stream, "flow_id", "1 hour").writeStream.format("parquet").option("path", f"{root}/again").option(
        "checkpointLocation", f"{root}/offsets2").trigger(availableNow=True).start()
    forgetful.awaitTermination()
    assert spark.read.parquet(f"{root}/again").count() == len(found)


def test_an_unfinished_warmup_is_scored(spark, flows, flow_frame):
    root = scratch_path(spark, "short")
    settings = AdaptiveSettings(batch_size=350, memory_size=500, warmup_batches=5, rank=0)
    ids = flow_frame["flow_id"].tolist()

    def deliver(part):
        part.coalesce(1).write.mode("append").parquet(f"{root}/input")
        score_available(spark.readStream.schema(flows.schema).parquet(f"{root}/input"), f"{root}/run", settings)

    deliver(flows.filter(F.col("flow_id").isin(ids[:600])))
    scored = spark.read.parquet(f"{root}/run/scored")
    assert scored.count() == 600 and {r.learning_phase for r in scored.select("learning_phase").distinct().collect()} == {"warmup"}
    assert not finish_warmup(spark, f"{root}/run", settings)
    deliver(flows.filter(F.col("flow_id").isin(ids[600:])))
    scored = spark.read.parquet(f"{root}/run/scored")
    assert scored.count() == len(ids) and scored.filter("learning_phase = 'adapt'").count() == len(ids) - 600
