"""The query catalogue: one callable per operator, each over whole tables.

Many queries score with ``rank=0``, i.e. without a subspace, which is quicker to
compare; the rank-4 queries next to them have comparison SQL of their own, in
which the subspace is the projector that powers of the scatter matrix tend to.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixtures as fx
from ..functions.numeric import number_or_zero
from ..functions.ports import port_band, service_name
from ..functions.text import canonical_protocol, infer_direction, normal_label
from ..operators import evaluate, features, knn, ranking, reports, resample, scoring, similarity, summary
from ..operators.baseline import FlowBaseline, context_totals
from ..operators.params import GroupParams
from ..operators.positions import assign_batches, time_order, with_position
from ..operators.prepare import (add_volumes, coerce_numbers, derive_missing, detect_units,
                                 fill_defaults, normalize_text, parse_timestamps, prepare_flows,
                                 scale_times, standardize_columns)
from ..operators.triplet import triplet_loss
from ..schema import ENCODER_COLUMNS, FEATURE_COLUMNS
from ..session import cut_lineage, scratch_path, spread
from ..sources import csv_flows, sinks, versions
from ..streaming.adaptive_stream import score_available
from .adaptive import AdaptiveSettings, adaptive_per_source, adaptive_run

Query = Callable[[SparkSession, str], DataFrame]
KEEP = StorageLevel.MEMORY_AND_DISK
_QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    _QUERIES[function.__name__] = function
    return function


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles cut to ``digits``, so last-bit differences of two engines do not show."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def featured(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.add_features(features.add_context_key(fx.flows(spark, sf_dir)))


def scored_flows(spark: SparkSession, sf_dir: str, rank: int = 0, by: str | None = None,
                 **options) -> tuple[DataFrame, FlowBaseline]:
    estimator = FlowBaseline(rank=rank, by=by)
    result = cut_lineage(estimator.fit_transform(fx.flows(spark, sf_dir), KEEP, **options), "scored")
    estimator.model.release()
    return result, estimator


# -- sources and sinks -----------------------------------------------------------

@query
def src_csv_flows(spark, sf_dir):
    """Write raw flows as CSV, read them back harmonised."""
    path = scratch_path(spark, "csv")
    sinks.write_csv(fx.raw_flows(spark, sf_dir, "src_dst_long"), path)
    flows, _ = csv_flows.load_flows(spark, [path], order_by=[F.col("flow_id").cast("long")])
    return rounded(flows.select(F.col("flow_id").cast("long").alias("flow_id"), "src_ip", "dst_ip", "src_port",
                                "dst_port", "protocol", "duration_sec", "packets", "label"))


@query
def src_units_per_file(spark, sf_dir):
    """Two captures with one header, one in seconds and one in microseconds, some labels over two lines."""
    path = scratch_path(spark, "units")
    raw = fx.raw_flows(spark, sf_dir, "src_dst_long")
    second = F.col("flow_id") % 2 == 1
    raw.withColumns({
        "duration": F.when(second, F.floor(F.col("duration").cast("double") * 1_000_000).cast("long").cast("string")).otherwise(F.col("duration")),
        "label": F.when(second & (F.col("flow_id") % 50 < 4), F.concat_ws("\n", F.lit("port, scan"), F.lit('"slow"'))).otherwise(F.col("label")),
        "file": F.when(second, "b").otherwise("a")}).write.partitionBy("file").options(header=True, escape='"').csv(path)
    flows, _ = csv_flows.load_flows(spark, [path], order_by=[F.col("flow_id").cast("long")])
    return rounded(flows.select(F.col("flow_id").cast("long").alias("flow_id"), "duration_sec", "label"))


@query
def src_skip_patterns(spark, sf_dir):
    names = ["day1.csv", "my_events.csv", "day2.csv", "UNSW_features.csv"]
    name = F.get(F.lit(names), (F.col("flow_id") % 4).cast("int"))
    return fx.flows(spark, sf_dir).filter(csv_flows.is_flow_file(name)).select("flow_id", "dst_port")


@query
def src_quarantine(spark, sf_dir):
    path = scratch_path(spark, "quarantine")
    raw = fx.raw_flows(spark, sf_dir, "src_dst_long")
    bad = (F.col("flow_id") % 4 == 1) & (F.col("flow_id") % 50 < 4)
    broken = raw.withColumns({
        "dst_port": F.when(bad, "0x01bb").otherwise(F.col("dst_port")),
        "file": F.concat(F.lit("part_"), (F.col("flow_id") % 4).cast("string"))})
    broken.write.partitionBy("file").option("header", True).csv(path)
    report = csv_flows.quarantine_report(spark, csv_flows.inspect(spark, csv_flows.discover(spark, [path])))
    return report.groupBy(F.regexp_extract("path", r"file=(part_\d)", 1).alias("file")).agg(
        F.sum("n_rows").alias("n_rows"), F.sum("bad_rows").alias("bad_rows"),
        F.bool_and("accepted").alias("accepted"))


@query
def src_union_tagged(spark, sf_dir):
    flows = fx.flows(spark, sf_dir)
    tables = {f"set_{i}": flows.filter(F.col("flow_id") % 3 == i).select("flow_id", "src_ip", "dst_port", "label")
              for i in range(3)}
    tables["set_1"] = tables["set_1"].drop("label")
    return ranking.union_tagged(tables).select("flow_id", "src_ip", "dst_port", "label", "dataset_source")


@query
def limit_sample(spark, sf_dir):
    return ranking.limit_rows(fx.flows(spark, sf_dir), 4000, "flow_id").select("flow_id", "src_ip")


@query
def embeddings_wide(spark, sf_dir):
    return sinks.embeddings_wide(fx.embeddings(spark, sf_dir), id_columns=["vec_id", "label"])


# -- preparation --------------------------------------------------------------------

def _named(spark, sf_dir, layout):
    return standardize_columns(fx.raw_flows(spark, sf_dir, layout))


@query
def std_columns(spark, sf_dir):
    named = _named(spark, sf_dir, "fwd_bwd")
    names = F.explode(F.lit(named.columns)).alias("column_name")
    return named.agg(F.count("*").alias("n_rows")).select(names, "n_rows")


@query
def prep_timestamp(spark, sf_dir):
    return parse_timestamps(_named(spark, sf_dir, "fwd_bwd")).select("flow_id", "timestamp")


@query
def prep_synth_ts(spark, sf_dir):
    flows = fx.flows(spark, sf_dir).drop("timestamp")
    return parse_timestamps(flows, [F.col("flow_id")]).select("flow_id", "timestamp")


@query
def prep_numeric(spark, sf_dir):
    raw = fx.raw_flows(spark, sf_dir, "fwd_bwd")
    columns = {"Flow Duration": "duration", "Total Length of Fwd Packets": "fwd_bytes", "Flow IAT Std": "iat_std"}
    return raw.select("flow_id", *[number_or_zero(F.col(c)).alias(n) for c, n in columns.items()])


@query
def prep_bidir_volume(spark, sf_dir):
    raw = standardize_columns(fx.raw_flows(spark, sf_dir, "src_dst_short"), volume="sum")
    return add_volumes(raw).select("flow_id", "packets", "bytes")


def _timed(spark, sf_dir, layout):
    named = _named(spark, sf_dir, layout)
    return scale_times(named, detect_units(named))


@query
def prep_duration_scale(spark, sf_dir):
    return rounded(_timed(spark, sf_dir, "fwd_bwd").select("flow_id", "duration_sec"))


@query
def prep_iat_scale(spark, sf_dir):
    return rounded(_timed(spark, sf_dir, "fwd_bwd").select(
        "flow_id", "inter_arrival_mean_ms", "inter_arrival_std_ms"))


@query
def prep_jitter_scale(spark, sf_dir):
    return rounded(_timed(spark, sf_dir, "src_dst_short").select(
        "flow_id", "inter_arrival_mean_ms", "inter_arrival_std_ms"))


@query
def prep_service_port(spark, sf_dir):
    return derive_missing(_named(spark, sf_dir, "src_dst_short")).select("flow_id", "dst_port")


@query
def prep_state_failed(spark, sf_dir):
    return derive_missing(_named(spark, sf_dir, "src_dst_short")).select("flow_id", "failed_connections")


@query
def prep_label(spark, sf_dir):
    label, category = F.col("Label"), F.col("attack_cat")
    return fx.raw_flows(spark, sf_dir, "src_dst_short").select(
        "flow_id", normal_label(label).alias("label"),
        normal_label(F.coalesce(label, category)).alias("label_or_category"),
        normal_label(label, "unknown").alias("label_null_unknown"))


@query
def prep_flag_ratio(spark, sf_dir):
    return rounded(derive_missing(_named(spark, sf_dir, "fwd_bwd")).select(
        "flow_id", "tcp_syn_ratio", "tcp_ack_ratio", "tcp_fin_ratio"))


@query
def prep_defaults(spark, sf_dir):
    return fill_defaults(_named(spark, sf_dir, "fwd_bwd")).select("flow_id", "direction", "src_ip", "src_port")


@query
def prep_direction(spark, sf_dir):
    src, dst = F.col("src_ip"), F.col("dst_ip")
    return fx.flows(spark, sf_dir).select("flow_id", infer_direction(src, dst).alias("direction"),
                                          infer_direction(dst, src).alias("direction_swapped"))


@query
def prep_clamp(spark, sf_dir):
    shifted = fx.flows(spark, sf_dir).withColumns({
        "packets": F.col("packets") - 20, "bytes": F.col("bytes") - 9000,
        "duration_sec": F.col("duration_sec") - 1,
        "inter_arrival_mean_ms": F.col("inter_arrival_mean_ms") * 3000 - 1000,
        "inter_arrival_std_ms": F.col("inter_arrival_std_ms") * 9000})
    return rounded(coerce_numbers(shifted).select(
        "flow_id", "packets", "bytes", "duration_sec", "inter_arrival_mean_ms", "inter_arrival_std_ms"))


@query
def prep_protocol(spark, sf_dir):
    numbers = F.get(F.lit(["17", " 6 ", "6.0", "icmpv6", ""]), (F.col("flow_id") % 5).cast("int"))
    return fx.raw_flows(spark, sf_dir, "src_dst_short").select(
        "flow_id", canonical_protocol(F.col("proto")).alias("protocol"),
        canonical_protocol(numbers).alias("protocol_number"))


@query
def prep_types(spark, sf_dir):
    named = fill_defaults(_named(spark, sf_dir, "fwd_bwd"))
    return normalize_text(named).select("flow_id", "direction", "src_ip", "dst_ip", "src_port", "dst_port")


@query
def prep_sorted(spark, sf_dir):
    parsed = parse_timestamps(_named(spark, sf_dir, "fwd_bwd"))
    return with_position(parsed.select("flow_id", "timestamp"), time_order("flow_id")).select("flow_id", "position")


@query
def prepare_flows_query(spark, sf_dir):
    flows = prepare_flows(fx.raw_flows(spark, sf_dir, "fwd_bwd"))
    return rounded(flows.select(
        "flow_id", "timestamp", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "direction",
        "duration_sec", "packets", "bytes", "tcp_syn_ratio", "tcp_ack_ratio", "tcp_fin_ratio",
        "inter_arrival_mean_ms", "inter_arrival_std_ms", "failed_connections", "label"))


_QUERIES["prepare_flows"] = _QUERIES.pop("prepare_flows_query")


# -- features --------------------------------------------------------------------------

@query
def flow_features(spark, sf_dir):
    expressions = features.feature_expressions()
    return rounded(fx.flows(spark, sf_dir).select("flow_id", *[e.alias(n) for n, e in expressions.items()]))


@query
def context_keys(spark, sf_dir):
    return features.add_context_key(fx.flows(spark, sf_dir)).select(
        "flow_id", port_band(F.col("dst_port")).alias("port_band"), "context_key")


@query
def service_name_query(spark, sf_dir):
    return fx.flows(spark, sf_dir).select("flow_id", "dst_port", service_name(F.col("dst_port")).alias("service"))


_QUERIES["service_name"] = _QUERIES.pop("service_name_query")


@query
def encoder_features(spark, sf_dir):
    flows = fx.flows(spark, sf_dir)
    return rounded(flows.select("flow_id", *[e.alias(n) for n, e in features.encoder_expressions(flows).items()]))


@query
def encoder_features_scaled(spark, sf_dir):
    flows = fx.flows(spark, sf_dir)
    scaled = features.scaled_encoder_expressions(flows, features.encoder_scaling(flows))
    return rounded(flows.select("flow_id", *[scaled[n].alias(n) for n in ENCODER_COLUMNS]))


# -- model --------------------------------------------------------------------------------

def _params_rows(spark, params: GroupParams, with_source: bool) -> DataFrame:
    data = [(g, n, values[f"med_{n}"], values[f"mad_{n}"]) for g, values in params.rows.items()
            for n in FEATURE_COLUMNS]
    table = spark.createDataFrame(data, "dataset_source string, feature string, median double, mad double")
    return rounded(table if with_source else table.drop("dataset_source"))


@query
def robust_params(spark, sf_dir):
    return _params_rows(spark, features.robust_params(featured(spark, sf_dir)), False)


@query
def per_source_robust_params(spark, sf_dir):
    return _params_rows(spark, features.robust_params(featured(spark, sf_dir), "dataset_source"), True)


@query
def robust_scaled(spark, sf_dir):
    table = featured(spark, sf_dir)
    joined, get = features.robust_params(table).attach(table)
    return rounded(joined.select("flow_id", *[
        F.expr(features.scaled_feature(n, get)).alias(n) for n in FEATURE_COLUMNS]))


@query
def scaled_mean(spark, sf_dir):
    table = featured(spark, sf_dir)
    joined, get = features.robust_params(table).attach(table)
    totals = context_totals(joined, get)
    sums = totals.agg(F.sum("rows").alias("rows"), *[F.sum(f"sum_{n}").alias(n) for n in FEATURE_COLUMNS])
    pairs = F.array(*[F.struct(F.lit(n).alias("feature"), (F.col(n) / F.col("rows")).alias("mean"))
                      for n in FEATURE_COLUMNS])
    return rounded(sums.select(F.inline(pairs)), 5)


@query
def context_frequency(spark, sf_dir):
    model = FlowBaseline(rank=0).fit(fx.flows(spark, sf_dir), KEEP)
    return rounded(model.context_frequency.select("context_key", "frequency"), 8)


@query
def subspace_energy(spark, sf_dir):
    """Singular values of the centred features and the share the subspace holds."""
    model = FlowBaseline().fit(fx.flows(spark, sf_dir), KEEP)
    values = model.singular_values[None]
    total = float((values ** 2).sum())
    data = [(i, float(v), float(v * v) / total, i < model.rank) for i, v in enumerate(values)]
    return spark.createDataFrame(data, "direction int, singular_value double, energy_share double, kept boolean")


@query
def model_params(spark, sf_dir):
    """Fit, save, load and show the parameter table."""
    path = scratch_path(spark, "model")
    model = FlowBaseline().fit(fx.flows(spark, sf_dir), KEEP)
    model.save(path)
    return type(model).load(spark, path).params_table(spark)


@query
def model_versions(spark, sf_dir):
    """Publish two models, load the last one, fitted on the known normal flows, and score all flows."""
    flows, root = fx.flows(spark, sf_dir), scratch_path(spark, "models")
    for known in (flows, ranking.benign_reference(flows)):
        model = FlowBaseline(rank=0).fit(known, KEEP)
        versions.publish(spark, root, model.save)
        model.release()
    loaded = type(model).load(spark, versions.folder_of(spark, root))
    return rounded(cut_lineage(loaded.transform(flows).select("flow_id", "anomaly_score", "is_anomaly", "risk_level", "traffic_class"), "scored"))


@query
def subspace_moments(spark, sf_dir):
    """Sums of the second, fourth and sixth powers of all singular values, as logarithms."""
    values = FlowBaseline().fit(fx.flows(spark, sf_dir), KEEP).singular_values[None].tolist()
    table = spark.createDataFrame([(v,) for v in values], "v double")
    powers = [F.log10(F.sum(F.pow("v", F.lit(float(p))))).alias(f"power_{p}") for p in (2, 4, 6)]
    return rounded(table.agg(*powers))


@query
def decision_threshold(spark, sf_dir):
    model = FlowBaseline(rank=0).fit(fx.flows(spark, sf_dir), KEEP)
    return rounded(spark.createDataFrame([(model.thresholds[None],)], "threshold double"))


def _parts(spark, sf_dir, rank):
    table = featured(spark, sf_dir)
    return FlowBaseline(rank=rank).fit(table, KEEP).add_scores(table)


@query
def score_distance(spark, sf_dir):
    return rounded(_parts(spark, sf_dir, 0).select("flow_id", "distance"))


@query
def score_reconstruction(spark, sf_dir):
    return rounded(_parts(spark, sf_dir, 4).select("flow_id", "reconstruction"))


@query
def score_rarity(spark, sf_dir):
    return rounded(_parts(spark, sf_dir, 0).select("flow_id", "rarity"))


@query
def anomaly_score(spark, sf_dir):
    return rounded(_parts(spark, sf_dir, 4).select("flow_id", "anomaly_score"))


@query
def risk_band(spark, sf_dir):
    score = F.col("anomaly_score")
    return _parts(spark, sf_dir, 0).select("flow_id", scoring.risk_band(score).alias("risk_level"),
                                           scoring.risk_band(score / 2).alias("risk_of_half"))


@query
def flags_without_subspace(spark, sf_dir):
    result, _ = scored_flows(spark, sf_dir)
    return rounded(result.select("flow_id", "anomaly_score", "is_anomaly"))


@query
def anomaly_flag(spark, sf_dir):
    result, _ = scored_flows(spark, sf_dir, rank=4)
    return rounded(result.select("flow_id", "anomaly_score", "is_anomaly"))


@query
def explain_top3(spark, sf_dir):
    table = featured(spark, sf_dir)
    joined, get = features.robust_params(table).attach(table)
    return scoring.add_explanation(joined, get).select("flow_id", "explanation")


@query
def classify_traffic(spark, sf_dir):
    """Signature classes of the flows labelled anomalous."""
    table = featured(spark, sf_dir).withColumn("is_anomaly", F.col("label") == "anomalous")
    joined, get = scoring.class_cuts(table.filter("is_anomaly")).attach(table)
    return joined.select("flow_id", scoring.traffic_class(F.col("is_anomaly"), get).alias("traffic_class"))


@query
def score_flows(spark, sf_dir):
    """Fit on the known normal flows, score all; the threshold is decided on the scored rows."""
    flows = fx.flows(spark, sf_dir)
    model = FlowBaseline().fit(ranking.benign_reference(flows), KEEP)
    return rounded(model.transform(flows, storage_level=KEEP).select(
        "flow_id", "service", "anomaly_score", "is_anomaly", "risk_level", "explanation", "traffic_class"))


@query
def fit_score_top_hits(spark, sf_dir):
    result, _ = scored_flows(spark, sf_dir, rank=4)
    return rounded(ranking.top_hits(result))


# -- summaries ------------------------------------------------------------------------------

@query
def summary_kpis(spark, sf_dir):
    return summary.summarize(scored_flows(spark, sf_dir)[0])


@query
def top_protocol(spark, sf_dir):
    return ranking.top_value(fx.flows(spark, sf_dir), "protocol")


@query
def class_breakdown(spark, sf_dir):
    return ranking.value_counts(scored_flows(spark, sf_dir)[0], "traffic_class")


@query
def label_masks(spark, sf_dir):
    labelled = fx.raw_flows(spark, sf_dir, "fwd_bwd").select("flow_id", normal_label(F.col("Label")).alias("label"))
    return summary.label_masks(labelled)


@query
def detection_quality(spark, sf_dir):
    flagged = fx.flows(spark, sf_dir).withColumn("is_anomaly", F.col("packets") > 40)
    return flagged.agg(*summary.quality_columns())


@query
def batch_summary(spark, sf_dir):
    batched = assign_batches(fx.flows(spark, sf_dir), 1000, "flow_id").withColumns({
        "batch_id": F.col("slice_id") + 1,
        "learning_phase": F.when(F.col("slice_id") == 0, "warmup").otherwise("adapt")})
    return summary.batch_summary(FlowBaseline(rank=0).fit_transform(batched, KEEP))


@query
def summary_versions(spark, sf_dir):
    """Publish the batch summaries twice, the first time in part, and read back the last version."""
    root, summaries = scratch_path(spark, "summaries"), batch_summary(spark, sf_dir)
    versions.publish_table(summaries.filter("batch_id = 1"), root)
    versions.publish_table(summaries, root)
    return versions.read_table(spark, root)


@query
def per_source_thresholds(spark, sf_dir):
    model = FlowBaseline(rank=0, by="dataset_source").fit(fx.flows(spark, sf_dir), KEEP)
    return rounded(spark.createDataFrame(list(model.thresholds.items()), "dataset_source string, threshold double"))


@query
def per_source_summary(spark, sf_dir):
    result, estimator = scored_flows(spark, sf_dir, by="dataset_source")
    return summary.per_source_summary(result, estimator.model.thresholds)


@query
def per_source_scores(spark, sf_dir):
    """Rank-4 models per source, fitted together."""
    result, _ = scored_flows(spark, sf_dir, rank=4, by="dataset_source")
    return rounded(result.select("flow_id", "dataset_source", "anomaly_score", "is_anomaly", "traffic_class"))


@query
def per_source_combined(spark, sf_dir):
    result, estimator = scored_flows(spark, sf_dir, rank=4, by="dataset_source")
    each = summary.per_source_summary(result, estimator.model.thresholds)
    return rounded(summary.combined_source_summary(result, each, 0.08))


@query
def per_source_flags(spark, sf_dir):
    """Models per source without a subspace."""
    result, _ = scored_flows(spark, sf_dir, by="dataset_source")
    return rounded(result.select("flow_id", "dataset_source", "anomaly_score", "is_anomaly", "traffic_class"))


@query
def per_source_overview(spark, sf_dir):
    result, estimator = scored_flows(spark, sf_dir, by="dataset_source")
    each = summary.per_source_summary(result, estimator.model.thresholds)
    return rounded(summary.combined_source_summary(result, each, 0.08))


@query
def score_unseen_flows(spark, sf_dir):
    """Fit without a subspace on the known normal flows, score all."""
    flows = fx.flows(spark, sf_dir)
    model = FlowBaseline(rank=0).fit(ranking.benign_reference(flows), KEEP)
    scored = cut_lineage(model.transform(flows, storage_level=KEEP).select(
        "flow_id", "anomaly_score", "is_anomaly", "risk_level", "traffic_class"), "scored")
    model.release()
    return rounded(scored)


# -- ranking -----------------------------------------------------------------------------------

@query
def top_hits(spark, sf_dir):
    hits = ranking.top_hits(scored_flows(spark, sf_dir)[0])
    return rounded(hits.select("flow_id", "src_ip", "dst_ip", "dst_port", "protocol", "anomaly_score"))


@query
def best_per_signature(spark, sf_dir):
    scored = scored_flows(spark, sf_dir)[0].select("flow_id", "src_ip", "dst_port", "protocol", "anomaly_score")
    best = ranking.best_per_signature(scored, ["src_ip", "dst_port", "protocol"], "flow_id")
    return rounded(best.select("flow_id", "src_ip", "dst_port", "anomaly_score"))


@query
def scored_sorted(spark, sf_dir):
    return rounded(ranking.sorted_by_score(scored_flows(spark, sf_dir)[0].select("flow_id", "anomaly_score")))


@query
def benign_reference(spark, sf_dir):
    return ranking.benign_reference(fx.flows(spark, sf_dir)).select("flow_id", "label")


@query
def benign_reference_sparse(spark, sf_dir):
    sparse = fx.flows(spark, sf_dir).select("flow_id", F.col("packets").alias("anomaly_score"), F.when(
        F.col("flow_id") % 100 == 0, "normal").when(F.col("flow_id") % 7 == 0, "unknown").otherwise("ddos").alias("label"))
    return ranking.benign_reference(sparse).select("flow_id", "label", "anomaly_score")


@query
def memory_window(spark, sf_dir):
    return ranking.latest_rows(fx.flows(spark, sf_dir), 5000).select("flow_id", "src_ip")


@query
def value_counts(spark, sf_dir):
    return ranking.value_counts(fx.flows(spark, sf_dir), "dst_port").orderBy(F.desc("count"))


@query
def distinct_rows(spark, sf_dir):
    return fx.flows(spark, sf_dir).select("src_ip", "dst_port", "protocol", "direction").dropDuplicates()


@query
def min_class_filter(spark, sf_dir):
    return resample.classes_with_at_least(fx.flows(spark, sf_dir).select("flow_id", "dst_ip"), "dst_ip", 2)


@query
def batch_assign(spark, sf_dir):
    return assign_batches(fx.flows(spark, sf_dir), 700, "flow_id").select("flow_id", "position", "slice_id")


# -- adaptive and streaming --------------------------------------------------------------------------

def _adaptive(spark, sf_dir, **settings):
    """A third of the table per batch: the warm-up and two steps at any scale."""
    flows = fx.flows(spark, sf_dir)
    return adaptive_run(flows, AdaptiveSettings(batch_size=-(-flows.count() // 3), **settings))


@query
def adaptive_scored(spark, sf_dir):
    return rounded(_adaptive(spark, sf_dir).scored().select(
        "flow_id", "batch_id", "slice_id", "learning_phase", "anomaly_score", "is_anomaly", "traffic_class"))


@query
def adaptive_summary(spark, sf_dir):
    return rounded(_adaptive(spark, sf_dir).summary())


@query
def relearn_decisions(spark, sf_dir):
    return rounded(_adaptive(spark, sf_dir).batch_summaries().orderBy("batch_id"))


@query
def adaptive_by_source(spark, sf_dir):
    flows = fx.flows(spark, sf_dir)
    _, summaries = adaptive_per_source(flows, AdaptiveSettings(batch_size=-(-flows.count() // 6)))
    return rounded(summaries)


@query
def adaptive_flags(spark, sf_dir):
    """The adaptive run without a subspace."""
    return rounded(_adaptive(spark, sf_dir, rank=0).scored().select(
        "flow_id", "batch_id", "slice_id", "learning_phase", "anomaly_score", "is_anomaly", "traffic_class"))


@query
def adaptive_overview(spark, sf_dir):
    return rounded(_adaptive(spark, sf_dir, rank=0).summary())


@query
def relearn_overview(spark, sf_dir):
    return rounded(_adaptive(spark, sf_dir, rank=0).batch_summaries())


def _with_decisions(learner):
    """Scored rows with what their batch's step decided and how many rows its memory then holds."""
    log = learner.log_table().select("batch_id", "relearn_status", "candidates", "memory_rows")
    return rounded(learner.scored().join(F.broadcast(log), "batch_id").select(
        "flow_id", "batch_id", "learning_phase", "anomaly_score", "is_anomaly", "relearn_status", "candidates", "memory_rows"))


@query
def adaptive_evicting(spark, sf_dir):
    """Five batches with a memory of half a batch: every step drops the oldest rows."""
    flows = fx.flows(spark, sf_dir)
    size = -(-flows.count() // 5)
    return _with_decisions(adaptive_run(flows, AdaptiveSettings(batch_size=size, memory_size=size // 2, rank=0)))


@query
def adaptive_skipping(spark, sf_dir):
    """Too few normal flows in the second of three batches: the third is scored by the model of the first."""
    flows = fx.flows(spark, sf_dir)
    size = -(-flows.count() // 3)
    placed = with_position(flows, time_order("flow_id"))
    attack = (F.floor(F.col("position") / size) == 1) & (F.col("flow_id") % 20 != 0)
    relabelled = placed.withColumn("label", F.when(attack, "ddos").otherwise(F.col("label"))).drop("position")
    return _with_decisions(adaptive_run(relabelled, AdaptiveSettings(batch_size=size, rank=0)))


@query
def stream_adaptive(spark, sf_dir):
    """The fixture as a stream: three deliveries, each scored as it arrives."""
    return _streamed(spark, sf_dir, AdaptiveSettings())


@query
def stream_flags(spark, sf_dir):
    """The stream without a subspace."""
    return _streamed(spark, sf_dir, AdaptiveSettings(rank=0))


def _streamed(spark, sf_dir, settings):
    root = scratch_path(spark, "stream")
    flows = fx.flows(spark, sf_dir)
    placed = assign_batches(flows, -(-flows.count() // 3), "flow_id").drop("position")
    for i in range(3):
        placed.filter(F.col("slice_id") == i).drop("slice_id").write.mode("append").parquet(f"{root}/input")
        stream = spark.readStream.schema(flows.schema).parquet(f"{root}/input")
        score_available(stream, f"{root}/run", settings)
    scored = spark.read.parquet(f"{root}/run/scored")
    return rounded(scored.select("flow_id", F.col("batch_id").cast("long").alias("batch_id"), "learning_phase",
                                 "anomaly_score", "is_anomaly"))


# -- embeddings ------------------------------------------------------------------------------------

@query
def training_labels(spark, sf_dir):
    return resample.training_labels(scored_flows(spark, sf_dir)[0]).select("flow_id", "training_label")


@query
def label_index(spark, sf_dir):
    return resample.label_index(fx.flows(spark, sf_dir).select("flow_id", "src_ip"), "src_ip").select("flow_id", "label_index")


def _split(spark, sf_dir):
    return resample.stratified_split(spread(fx.embeddings(spark, sf_dir)), "label", "vec_id")


@query
def stratified_split(spark, sf_dir):
    return _split(spark, sf_dir).select("vec_id", "label", "is_test")


@query
def balanced_resample(spark, sf_dir):
    flows = fx.flows(spark, sf_dir).select("flow_id", "label")
    return resample.balanced_resample(flows, "label", "flow_id").select("flow_id", "label", "draw")


@query
def triplet_loss_query(spark, sf_dir):
    vectors = fx.embeddings(spark, sf_dir).withColumn("batch", F.floor(F.col("vec_id") / 128))
    return rounded(triplet_loss(vectors, "batch"))


_QUERIES["triplet_loss"] = _QUERIES.pop("triplet_loss_query")


def _neighbours(spark, sf_dir):
    split = _split(spark, sf_dir)
    return split, knn.nearest_neighbours(split.filter("is_test"), split.filter("NOT is_test"))


def _judged(spark, sf_dir):
    split, near = _neighbours(spark, sf_dir)
    truth = split.select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("truth"))
    return knn.predict(near).join(truth, "id")


@query
def knn_predict(spark, sf_dir):
    return knn.predict(_neighbours(spark, sf_dir)[1])


@query
def knn_proba(spark, sf_dir):
    split, near = _neighbours(spark, sf_dir)
    classes = [r[0] for r in split.filter("NOT is_test").select(F.col("label").cast("string")).distinct().collect()]
    return rounded(knn.predict_proba(near, sorted(classes)))


@query
def confusion_matrix(spark, sf_dir):
    return evaluate.confusion_matrix(_judged(spark, sf_dir))


@query
def classification_report(spark, sf_dir):
    return rounded(evaluate.classification_report(evaluate.confusion_matrix(_judged(spark, sf_dir))))


@query
def cosine_pairs(spark, sf_dir):
    """Every vector against the first vector of each class."""
    vectors = fx.embeddings(spark, sf_dir)
    probes = vectors.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("embedding"),
                                          F.min("vec_id").alias("vec_id"))
    return rounded(similarity.cosine_to(vectors, probes))


@query
def cosine_join(spark, sf_dir):
    """All pairs of vectors with a cosine of at least 0.35."""
    return rounded(similarity.cosine_join(spread(fx.embeddings(spark, sf_dir)), 0.35))


@query
def knn_pivots(spark, sf_dir):
    """The votes of nearest neighbours that are found without a broadcast: by pivots, or tile by tile if those leave out too little."""
    split = _split(spark, sf_dir)
    return knn.predict(knn.nearest_neighbours(split.filter("is_test"), split.filter("NOT is_test"), broadcast_bytes=0))


def _sums(spark, sf_dir):
    return similarity.class_sums(fx.embeddings(spark, sf_dir).withColumn("label", F.col("label").cast("string")))


@query
def cosine_intra(spark, sf_dir):
    return rounded(similarity.intra_class(_sums(spark, sf_dir)))


@query
def cosine_inter(spark, sf_dir):
    return rounded(similarity.inter_class(_sums(spark, sf_dir)))


@query
def embedding_kpis(spark, sf_dir):
    return rounded(similarity.embedding_kpis(fx.embeddings(spark, sf_dir)))


# -- reports -----------------------------------------------------------------------------------------

@query
def report_protocols(spark, sf_dir):
    return reports.protocol_counts(fx.flows(spark, sf_dir))


@query
def report_risk(spark, sf_dir):
    return reports.risk_counts(scored_flows(spark, sf_dir)[0])


@query
def report_classes(spark, sf_dir):
    return reports.class_shares(scored_flows(spark, sf_dir)[0])


@query
def report_cards(spark, sf_dir):
    flows = fx.flows(spark, sf_dir)
    return reports.summary_cards(flows.agg(
        F.count("*").alias("total_flows"), F.mode("protocol", True).alias("top_protocol"),
        F.count_distinct("dataset_source").alias("source_models")))


@query
def report_top_hits(spark, sf_dir):
    rows = reports.top_hit_rows(scored_flows(spark, sf_dir)[0])
    return rows.withColumn("second", F.substring("timestamp", 1, 19)).drop("timestamp")


def queries() -> dict[str, Query]:
    return dict(_QUERIES)
