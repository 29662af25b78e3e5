"""Summary tables over scored flows, each one aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_known_attack, is_known_normal
from ..schema import TRAFFIC_CLASSES
from .quantiles import exact_quantiles


def label_masks(flows: DataFrame) -> DataFrame:
    label = F.col("label")
    return flows.withColumns({"known_attack": is_known_attack(label),
                              "known_normal": is_known_normal(label)})


def _percent(part: Column, whole: Column) -> Column:
    return F.round(part * 100.0 / F.nullif(whole, F.lit(0)), 2)


def score_columns(digits: int = 4) -> list[Column]:
    """Flow counts, flag rate in percent, mean and maximum score."""
    flagged = F.count_if("is_anomaly")
    return [
        F.count("*").alias("total_flows"),
        flagged.alias("flagged_flows"),
        _percent(flagged, F.count("*")).alias("flag_rate"),
        F.round(F.avg("anomaly_score"), digits).alias("mean_score"),
        F.round(F.max("anomaly_score"), digits).alias("max_score"),
    ]


def top_protocol_column() -> Column:
    """Most frequent protocol, the alphabetically first one of a tie."""
    return F.coalesce(F.mode("protocol", True), F.lit("N/A")).alias("top_protocol")


def quality_columns(with_recall: bool = True) -> list[Column]:
    """Detection quality against labels; null where its denominator is zero."""
    attack, normal = is_known_attack(F.col("label")), is_known_normal(F.col("label"))
    attacks, normals = F.count_if(attack), F.count_if(normal)
    detected = F.count_if(attack & F.col("is_anomaly"))
    false_alarms = F.count_if(normal & F.col("is_anomaly"))
    columns = [
        attacks.alias("known_attack_flows"),
        normals.alias("known_normal_flows"),
        F.when(attacks > 0, detected).alias("detected_known_attacks"),
        F.when(normals > 0, false_alarms).alias("benign_false_positives"),
        _percent(false_alarms, normals).alias("benign_false_positive_rate"),
    ]
    if with_recall:
        columns.append(_percent(detected, attacks).alias("known_attack_recall"))
    return columns


def summarize(scored: DataFrame, by: list[str] | None = None, with_recall: bool = True,
              with_classes: bool = False) -> DataFrame:
    """The summary row of a scored table, or one row per group.

    ``with_classes`` adds ``class_breakdown``, the flows of each traffic class.
    """
    columns = [*score_columns(), top_protocol_column()]
    if "label" in scored.columns:
        columns += quality_columns(with_recall)
    if with_classes:  # the classes are a fixed short list, so a column counts each
        counts = [F.struct(F.lit(c).alias("key"), F.count_if(F.col("traffic_class") == c).alias("value")) for c in TRAFFIC_CLASSES]
        columns.append(F.map_from_entries(F.filter(F.array(*counts), lambda x: x["value"] > 0)).alias("class_breakdown"))
    return scored.groupBy(*(by or [])).agg(*columns)


def batch_summary(scored: DataFrame) -> DataFrame:
    """One row per batch of an adaptive run."""
    columns = score_columns()
    if "label" in scored.columns:
        columns += quality_columns(with_recall=False)
    return (scored.groupBy("batch_id", "learning_phase").agg(*columns)
            .withColumnsRenamed({"total_flows": "batch_size", "learning_phase": "phase"}))


def per_source_summary(scored: DataFrame, thresholds: dict[object, float],
                       by: str = "dataset_source") -> DataFrame:
    """Summary per source, with the threshold of its own model."""
    from .params import GroupParams

    joined, get = GroupParams(by, {g: {"t": t} for g, t in thresholds.items()}).attach(
        summarize(scored, [by]))
    return GroupParams.detach(joined.withColumn("threshold", F.round(F.expr(get("t")), 4)))


def combined_source_summary(scored: DataFrame, per_source: DataFrame, contamination: float,
                            by: str = "dataset_source") -> DataFrame:
    """Overall summary of per-source models.

    ``overall_score_quantile`` describes all scores together and re-flags
    nothing; it uses the contamination as given, not clipped.
    """
    rows = scored.count()
    quantile = exact_quantiles(
        scored, {"q": (F.col("anomaly_score"), [1 - contamination])}, rows=rows)[None]["q"][0]
    listed = per_source.select(by, "threshold").orderBy(by).collect()
    text = ", ".join(f"{r[by]}={r['threshold']}" for r in listed)
    return summarize(scored).withColumns({
        "source_models": F.lit(len(listed)).cast("long"),
        "per_source_thresholds": F.lit(text),
        "overall_score_quantile": F.lit(quantile),
    })
