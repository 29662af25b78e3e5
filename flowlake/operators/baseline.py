"""The anomaly baseline: fit on flows, score flows, for all rows or per group."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import FEATURE_COLUMNS, SUBSPACE_RANK, ZERO_MAD
from ..session import cut_lineage
from .features import (FEATURE_PREFIX, add_context_key, add_features, add_service, robust_params,
                       scaled_feature)
from .params import GroupParams, small_or_written
from .quantiles import SMALL_ROWS
from .scoring import (add_explanation, anomaly_score, centred_columns, class_cuts, decision_thresholds, distance_score,
                      joined_directions, literal_directions, rarity_score,
                      reconstruction_error, risk_band, traffic_class)
from .subspace import leading_directions, merged_factors

_WORK_COLUMNS = [FEATURE_PREFIX + n for n in FEATURE_COLUMNS]


def clipped_contamination(value: float) -> float:
    return min(max(float(value), 0.01), 0.35)


def context_totals(features: DataFrame, get, by: str | None = None) -> DataFrame:
    """Row count and feature sums per context key: one pass feeds both the
    context frequencies and the mean vector."""
    keys = [by] if by else []
    sums = [F.expr(f"sum({scaled_feature(n, get)})").alias(f"sum_{n}") for n in FEATURE_COLUMNS]
    return features.groupBy(*keys, "context_key").agg(F.count("*").alias("rows"), *sums)


@dataclass
class FlowBaselineModel:
    """Fitted parameters. ``params`` and ``components`` are keyed by group."""

    contamination: float
    rank: int
    by: str | None
    params: GroupParams
    components: dict[object, np.ndarray]
    singular_values: dict[object, np.ndarray]
    context_frequency: DataFrame
    contexts_small: bool
    thresholds: dict[object, float] = field(default_factory=dict)
    rows: int = 0
    scoring_thresholds: dict[object, float] = field(default_factory=dict)
    _held: list[DataFrame] = field(default_factory=list)

    # -- scoring ------------------------------------------------------------
    def _attach(self, df: DataFrame):
        """Parameters and directions: literals for one model, one join for many."""
        if self.by is None:
            joined, get = self.params.attach(df)
            return joined, get, literal_directions(self.components.get(None, np.zeros((0, 0))))
        wide = {g: dict(values) for g, values in self.params.rows.items()}
        for g, directions in self.components.items():
            for k in range(self.rank):
                for i in range(len(FEATURE_COLUMNS)):
                    wide[g][f"v{k}_{i}"] = float(directions[k][i]) if k < len(directions) else 0.0
        joined, get = GroupParams(self.by, wide).attach(df)
        return joined, get, joined_directions(get, self.rank)

    def add_scores(self, features: DataFrame) -> DataFrame:
        """Add distance, reconstruction, rarity and anomaly_score to a feature table."""
        joined, get, directions = self._attach(features)
        contexts = self.context_frequency
        names = {c: f"_x_{c}" for c in contexts.columns}
        contexts = contexts.withColumnsRenamed(names)
        on = joined["context_key"] == contexts["_x_context_key"]
        if self.by:
            on = on & joined[self.by].eqNullSafe(contexts[f"_x_{self.by}"])
        if self.contexts_small:
            contexts = F.broadcast(contexts)
        centred = joined.withColumns(centred_columns(get)).join(contexts, on, "left")
        scored = centred.withColumns({
            "distance": distance_score(),
            "reconstruction": reconstruction_error(directions),
            "rarity": rarity_score(F.col("_x_frequency")),
        }).withColumn("anomaly_score", anomaly_score())
        drop = [f"c_{i}" for i in range(len(FEATURE_COLUMNS))] + list(names.values())
        return GroupParams.detach(scored.drop(*drop))

    def transform(self, flows: DataFrame, *, keep_features: bool = False,
                  use_fit_thresholds: bool = False, rows: int | None = None,
                  storage_level: StorageLevel | None = None) -> DataFrame:
        """Score, flag, band, explain and classify canonical flows.

        The threshold is decided on the scored rows with the fitted one as a
        floor; ``use_fit_thresholds`` skips that for the rows fitted on, where
        both are equal. ``storage_level`` keeps the scored rows between the
        passes for the threshold, the class cuts and the result.
        """
        prepared = flows
        if _WORK_COLUMNS[0] not in flows.columns:
            prepared = add_features(add_context_key(flows))
        scored = self.add_scores(prepared)
        if storage_level is not None:
            scored = scored.persist(storage_level)
            self._held.append(scored)
        if rows is None:
            rows = flows.count()
        if use_fit_thresholds:
            thresholds = self.thresholds
        else:
            thresholds = self._thresholds(scored, rows, self.thresholds)
        self.scoring_thresholds = thresholds
        cut = GroupParams(self.by, {g: {"threshold": t} for g, t in thresholds.items()})
        joined, get = cut.attach(scored)
        flagged = GroupParams.detach(joined.withColumn(
            "is_anomaly", F.coalesce(F.col("anomaly_score") >= F.expr(get("threshold")), F.lit(False))))
        cuts = class_cuts(flagged.filter("is_anomaly"), self.by, rows)

        with_cuts, cut_of = cuts.attach(flagged)
        classed = GroupParams.detach(with_cuts.withColumn(
            "traffic_class", traffic_class(F.col("is_anomaly"), cut_of)))
        explained, get = self.params.attach(classed)
        banded = add_service(explained).withColumn("risk_level", risk_band(F.col("anomaly_score")))
        result = GroupParams.detach(add_explanation(banded, get))
        if keep_features:
            return result
        return result.drop(*_WORK_COLUMNS, "context_key", "distance", "reconstruction", "rarity")

    def _thresholds(self, scored: DataFrame, rows: int, baseline: dict | None = None) -> dict:
        """Thresholds from a narrow score table: scores are computed once, not per scan."""
        keep = ([self.by] if self.by else []) + (["label"] if "label" in scored.columns else [])
        narrow = scored.select(*keep, "anomaly_score")
        if rows > SMALL_ROWS and not scored.is_cached:
            narrow = cut_lineage(narrow, "scores")
        return decision_thresholds(narrow, self.contamination, self.by, baseline, rows)

    def release(self) -> None:
        """Let go of the rows kept between passes, once the results are written."""
        while self._held:
            self._held.pop().unpersist()

    # -- persistence ----------------------------------------------------------
    def params_table(self, spark: SparkSession) -> DataFrame:
        """One row per group: vectors, directions and threshold."""
        data = []
        for g, values in self.params.rows.items():
            data.append((
                None if g is None else str(g),
                [values[f"med_{n}"] for n in FEATURE_COLUMNS],
                [values[f"mad_{n}"] for n in FEATURE_COLUMNS],
                [values[f"mean_{n}"] for n in FEATURE_COLUMNS],
                [[float(x) for x in v] for v in self.components[g]],
                [float(x) for x in self.singular_values[g]],
                self.thresholds.get(g), self.contamination, self.rank, self.rows))
        schema = ("group_key string, medians array<double>, mads array<double>, means array<double>, "
                  "components array<array<double>>, singular_values array<double>, threshold double, "
                  "contamination double, subspace_rank int, fitted_rows long")
        return spark.createDataFrame(data, schema)

    def save(self, path: str) -> None:
        """Write the parameter and context tables below ``path``."""
        spark = self.context_frequency.sparkSession
        self.params_table(spark).withColumn("group_column", F.lit(self.by)).write.mode(
            "overwrite").parquet(f"{path}/params")
        self.context_frequency.write.mode("overwrite").parquet(f"{path}/contexts")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "FlowBaselineModel":
        table = spark.read.parquet(f"{path}/params")
        by = table.first()["group_column"]
        contexts = spark.read.parquet(f"{path}/contexts")
        key_type = contexts.schema[by].dataType.simpleString() if by else "string"
        rows = table.withColumn("_key", F.col("group_key").cast(key_type)).collect()

        def key(row):
            return row["_key"]

        params = GroupParams(by, {key(r): {
            f"{kind}_{n}": r[column][i]
            for kind, column in (("med", "medians"), ("mad", "mads"), ("mean", "means"))
            for i, n in enumerate(FEATURE_COLUMNS)} for r in rows})
        return FlowBaselineModel(
            rows[0]["contamination"], rows[0]["subspace_rank"], by, params,
            {key(r): np.array(r["components"]).reshape(-1, len(FEATURE_COLUMNS)) for r in rows},
            {key(r): np.array(r["singular_values"]) for r in rows},
            *small_or_written(contexts, "contexts"),
            {key(r): r["threshold"] for r in rows}, rows[0]["fitted_rows"])


class FlowBaseline:
    """Estimator of the anomaly baseline.

    ``by`` names a column (such as ``dataset_source``) whose groups get a
    model each; all groups are fitted together, in the same few scans.
    """

    def __init__(self, contamination: float = 0.08, rank: int = SUBSPACE_RANK,
                 by: str | None = None, mad_floor: float = ZERO_MAD):
        self.contamination = clipped_contamination(contamination)
        self.rank, self.by, self.mad_floor = rank, by, mad_floor

    def _features(self, flows: DataFrame) -> DataFrame:
        keep = ([self.by] if self.by else []) + (["label"] if "label" in flows.columns else [])
        if _WORK_COLUMNS[0] not in flows.columns:
            flows = add_features(add_context_key(flows))
        return flows.select(*keep, "context_key", *_WORK_COLUMNS)

    def fit(self, flows: DataFrame, storage_level: StorageLevel | None = None) -> FlowBaselineModel:
        """Fit on canonical flows; a handful of scans, none of them shuffling rows."""
        features = self._features(flows)
        if storage_level is not None:
            features = features.persist(storage_level)
        unreadable = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in _WORK_COLUMNS])
        size = features.select(F.spark_partition_id().alias("task"), unreadable.alias("unreadable")).agg(
            F.count("*").alias("rows"), F.max("task").alias("last"), F.count_if("unreadable").alias("unreadable")).first()
        if not size["rows"]:
            raise ValueError("no flows to fit on")
        if size["unreadable"]:
            raise ValueError(f"{size['unreadable']} flows have null features, such as a port that is no number")
        rows = size["rows"]
        params = robust_params(features, self.by, rows, self.mad_floor)

        joined, get = params.attach(features)
        totals, small = small_or_written(context_totals(joined, get, self.by), "contexts")
        keys = [self.by] if self.by else []
        text = F.col(self.by).cast("string") if self.by else F.lit(None).cast("string")
        means = totals.groupBy(*keys).agg(
            F.sum("rows").alias("rows"), *([F.first(text).alias("_text")] if keys else []),
            *[F.sum(f"sum_{n}").alias(n) for n in FEATURE_COLUMNS]).collect()
        group_rows, names = {}, {}
        for row in means:
            g = row[self.by] if self.by else None
            group_rows[g], names[g] = row["rows"], row["_text"] if self.by else None
            params.rows[g].update({f"mean_{n}": row[n] / row["rows"] for n in FEATURE_COLUMNS})
        sizes = GroupParams(self.by, {g: {"n": float(n)} for g, n in group_rows.items()})
        framed, size_of = sizes.attach(totals)
        frequency = GroupParams.detach(framed.select(
            *keys, "context_key", (F.col("rows") / F.expr(size_of("n"))).alias("frequency")))

        components, singular = self._subspace(features, params, size["last"] + 1, group_rows, names)
        model = FlowBaselineModel(self.contamination, self.rank, self.by, params, components,
                                  singular, frequency, small, rows=rows)
        model.thresholds = model._thresholds(model.add_scores(features), rows)
        if storage_level is not None:
            features.unpersist()
        return model

    def _subspace(self, features: DataFrame, params: GroupParams, tasks: int, group_rows: dict, names: dict):
        width = len(FEATURE_COLUMNS)
        if self.rank == 0:
            return ({g: np.zeros((0, width)) for g in group_rows},
                    {g: np.zeros(0) for g in group_rows})
        joined, get = params.attach(features)
        centred = [F.expr(f"{scaled_feature(n, get)} - {get(f'mean_{n}')}") for n in FEATURE_COLUMNS]
        factors = merged_factors(joined, centred, self.by, tasks, len(group_rows))
        components, singular = {}, {}
        for g, n in group_rows.items():
            r = factors[names[g]]
            components[g], singular[g] = leading_directions(r, min(self.rank, n))
        return components, singular

    def fit_transform(self, flows: DataFrame, storage_level: StorageLevel | None = None,
                      **options) -> DataFrame:
        """Fit and score the same flows."""
        if storage_level is not None and _WORK_COLUMNS[0] not in flows.columns:
            flows = add_features(add_context_key(flows)).persist(storage_level)
        self.model = self.fit(flows, None)
        if flows.is_cached:
            self.model._held.append(flows)
        return self.model.transform(flows, use_fit_thresholds=True, rows=self.model.rows,
                                    storage_level=storage_level, **options)
