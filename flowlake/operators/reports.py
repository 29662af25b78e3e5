"""The data behind the report: counts, cards and the top-hit table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranking import top_hits, value_counts


def protocol_counts(scored: DataFrame) -> DataFrame:
    return value_counts(scored, "protocol")


def risk_counts(scored: DataFrame) -> DataFrame:
    """Risk bands of the flagged flows, of all flows without a flag."""
    flagged = scored.filter("is_anomaly") if "is_anomaly" in scored.columns else scored
    return value_counts(flagged, "risk_level")


def class_shares(scored: DataFrame) -> DataFrame:
    """Flows and percentage per traffic class; the window spans the few classes only."""
    counts = value_counts(scored, "traffic_class")
    total = F.sum("count").over(Window.partitionBy(F.lit(0)))
    return counts.withColumn("percent", F.round(F.col("count") * 100.0 / total, 1))


def summary_cards(summary: DataFrame) -> DataFrame:
    """A one-row summary as title/value pairs; nested and empty values are left out."""
    flat = [n for n, t in summary.dtypes if not t.startswith(("map", "struct", "array"))]
    pairs = ", ".join(f"'{n.replace('_', ' ').title()}', CAST(`{n}` AS STRING)" for n in flat)
    return summary.selectExpr(f"stack({len(flat)}, {pairs}) AS (card, value)").filter("value IS NOT NULL")


def top_hit_rows(scored: DataFrame, count: int = 5, key: str = "flow_id") -> DataFrame:
    """The top hits as display text."""
    hits = top_hits(scored, count, key)
    present = set(hits.columns)

    def text(name: str, default: str = ""):
        value = F.col(name).cast("string") if name in present else F.lit(None).cast("string")
        return F.coalesce(value, F.lit(default))

    score = F.col("anomaly_score") if "anomaly_score" in present else F.lit(0.0)
    return hits.select(
        text("timestamp").alias("timestamp"),
        text("dataset_source", "local").alias("dataset_source"),
        text("src_ip").alias("src_ip"),
        text("dst_ip").alias("dst_ip"),
        F.concat(text("protocol"), F.lit("/"), text("dst_port", "0")).alias("service"),
        F.replace(F.format_number(score, 3), F.lit(","), F.lit("")).alias("score"),
        text("risk_level").alias("risk_level"),
        text("traffic_class").alias("traffic_class"),
        text("explanation").alias("explanation"),
    )
