"""Anomaly scores, bands, explanations and signature classes as expressions."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import fixed_text
from ..functions.text import is_known_normal
from ..schema import (CLIP, FEATURE_COLUMNS, FEATURE_WORDING, RISK_BANDS, UNSEEN_FREQUENCY,
                      WEIGHT_DISTANCE, WEIGHT_RARITY, WEIGHT_RECONSTRUCTION)
from .features import FEATURE_PREFIX, feature, scaled_feature
from .params import GroupParams, sql_number
from .quantiles import exact_quantiles

_WIDTH = len(FEATURE_COLUMNS)


def centred_columns(get) -> dict[str, Column]:
    """``c_<i>``: scaled, centred and clipped features."""
    return {f"c_{i}": F.expr(f"least(greatest({scaled_feature(n, get)} - {get(f'mean_{n}')}, "
                             f"{-CLIP}D), {CLIP}D)") for i, n in enumerate(FEATURE_COLUMNS)}


_SQUARED_LENGTH = "(" + " + ".join(f"c_{i} * c_{i}" for i in range(_WIDTH)) + ")"


def distance_score() -> Column:
    """Root mean square of the centred features."""
    return F.expr(f"sqrt({_SQUARED_LENGTH} / {_WIDTH})")


def reconstruction_error(directions: list[list[str]]) -> Column:
    """Root mean square left after projecting on the subspace.

    ``directions`` holds the entries of each direction as SQL text. They are
    orthonormal, so the residual is what the projections leave of the squared
    length.
    """
    residual = _SQUARED_LENGTH
    for direction in directions:
        projection = " + ".join(f"c_{i} * {v}" for i, v in enumerate(direction))
        residual += f" - power({projection}, 2)"
    return F.expr(f"sqrt(greatest({residual}, 0D) / {_WIDTH})")


def literal_directions(components: np.ndarray) -> list[list[str]]:
    return [[sql_number(x) for x in direction] for direction in components]


def joined_directions(get, rank: int) -> list[list[str]]:
    return [[get(f"v{k}_{i}") for i in range(_WIDTH)] for k in range(rank)]


def rarity_score(frequency: Column) -> Column:
    return -F.log(F.coalesce(frequency, F.lit(UNSEEN_FREQUENCY)))


def anomaly_score() -> Column:
    return (F.col("distance") * WEIGHT_DISTANCE + F.col("reconstruction") * WEIGHT_RECONSTRUCTION
            + F.col("rarity") * WEIGHT_RARITY)


def decision_thresholds(scored: DataFrame, contamination: float, by: str | None = None,
                        baseline: dict | None = None, rows: int | None = None) -> dict:
    """Per group the largest of the threshold candidates.

    Candidates: the baseline if given, the ``1 - contamination`` quantile of
    all scores, and with labels the 0.995 quantile and a median/MAD cut of
    the scores of known normal flows.
    """
    score = F.col("anomaly_score")
    targets = {"all": (score, [1 - contamination])}
    labelled = "label" in scored.columns
    if labelled:
        normal = F.when(is_known_normal(F.col("label")), score)
        targets["normal"] = (normal, [0.5, 0.995])
    first = exact_quantiles(scored, targets, by, rows)
    candidates = {g: [q["all"][0]] for g, q in first.items()}
    if labelled and any(q["normal"][0] is not None for q in first.values()):
        medians = GroupParams(by, {g: {"m": q["normal"][0]} for g, q in first.items()})
        joined, get = medians.attach(scored)
        spread = F.abs(F.when(is_known_normal(F.col("label")), score) - F.expr(get("m")))
        second = exact_quantiles(joined, {"mad": (spread, [0.5])}, by, rows)
        for g, q in first.items():
            median, high = q["normal"]
            if median is not None:
                candidates[g] += [high, median + max(3.5 * second[g]["mad"][0], 1.0)]
    for g, value in (baseline or {}).items():
        if g in candidates and value is not None:
            candidates[g].append(value)
    return {g: max(v for v in values if v is not None) for g, values in candidates.items()
            if any(v is not None for v in values)}


def risk_band(score: Column) -> Column:
    bands = reduce(lambda chain, band: chain.when(score >= band[0], band[1]),
                   RISK_BANDS[1:], F.when(score >= RISK_BANDS[0][0], RISK_BANDS[0][1]))
    return bands.otherwise("low")


def add_explanation(features: DataFrame, get, count: int = 3) -> DataFrame:
    """Name the features furthest from their median, ties in vector order.

    The largest deviation is picked ``count`` times over plain columns, which
    stays in generated code; sorting an array per row is far slower.
    """
    deviations = features.withColumns({
        f"d_{i}": F.expr(f"abs({scaled_feature(n, get)})") for i, n in enumerate(FEATURE_COLUMNS)})
    work = [f"d_{i}" for i in range(_WIDTH)]
    for k in range(count):
        def left(i: int) -> str:
            taken = " OR ".join(f"top_{j} = {i}" for j in range(k))
            return f"CASE WHEN {taken} THEN -1D ELSE d_{i} END" if taken else f"d_{i}"

        deviations = deviations.withColumn(
            f"most_{k}", F.expr(f"greatest({', '.join(left(i) for i in range(_WIDTH))})"))
        free = "".join(f" AND top_{j} <> {{i}}" for j in range(k))
        cases = " ".join(f"WHEN d_{i} = most_{k}{free.format(i=i)} THEN {i}" for i in range(_WIDTH))
        deviations = deviations.withColumn(f"top_{k}", F.expr(f"CASE {cases} END"))
        work += [f"most_{k}", f"top_{k}"]
    wording = F.lit([FEATURE_WORDING.get(n, n) for n in FEATURE_COLUMNS])
    parts = []
    for k in range(count):
        cases = " ".join(f"WHEN {i} THEN {FEATURE_PREFIX}{n}" for i, n in enumerate(FEATURE_COLUMNS))
        deviations = deviations.withColumn(f"value_{k}", F.expr(f"CASE top_{k} {cases} END"))
        work.append(f"value_{k}")
        parts += [F.get(wording, F.col(f"top_{k}")), F.lit("="), fixed_text(F.col(f"value_{k}")), F.lit(", ")]
    context = [F.lit("context="), F.col("protocol"), F.lit("/"), F.col("direction"),
               F.lit("/port-"), F.col("dst_port").cast("string")]
    return deviations.withColumn("explanation", F.concat(*parts, *context)).drop(*work)


def class_cuts(flagged: DataFrame, by: str | None = None, rows: int | None = None) -> GroupParams:
    """Rate and size cuts taken from the flagged flows of each group."""
    cuts = exact_quantiles(flagged, {
        "pps_high": (feature("packets_per_sec"), [0.6]),
        "bps_high": (feature("bytes_per_sec"), [0.6]),
        "bpp_low": (feature("bytes_per_packet"), [0.4]),
    }, by, rows)
    return GroupParams(by, {g: {n: v[0] for n, v in q.items()} for g, q in cuts.items()})


def traffic_class(flagged: Column, get) -> Column:
    """Signature class of a flagged flow; the first rule that fits wins."""
    pps, bps = feature("packets_per_sec"), feature("bytes_per_sec")
    syn, failed = feature("tcp_syn_ratio"), F.col("failed_connections")
    gap, jitter = feature("log_inter_arrival_mean_ms"), feature("log_inter_arrival_std_ms")
    variation = F.when(gap > 0.1, jitter / (gap + 1e-6)).otherwise(1.0)
    pps_high, bps_high, bpp_low = (F.expr(get(n)) for n in ("pps_high", "bps_high", "bpp_low"))
    fast, wide = pps >= pps_high, bps >= bps_high
    return (
        F.when(~F.coalesce(flagged, F.lit(False)), "BENIGN")
        .when((variation < 0.35) & (pps < pps_high), "Botnet")
        .when(wide & (feature("is_uncommon_port") == 1), "Infiltration")
        .when(feature("is_web_service") == 1, "Web Attack")
        .when((feature("is_admin_service") == 1) & (failed >= 1), "Brute Force")
        .when((syn >= 0.55) & (feature("bytes_per_packet") <= bpp_low) & (failed >= 1),
              "Port Scan")
        .when((fast & (syn >= 0.35) & (feature("is_tcp") == 1)) | (wide & fast), "DoS/DDoS")
        .otherwise("Unknown Anomaly"))
