"""Adaptive scoring: a model that keeps relearning from ordered batches.

Batch ``b`` is scored by what was learned up to ``b - 1``, so batches follow
one another; inside a batch everything is a distributed job. State lives in
versioned tables below one root folder: a step reads earlier versions and
writes its own, in overwrite mode, so a repeated step gives the same result.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.baseline import FlowBaseline, FlowBaselineModel
from ..operators.positions import PlacedTable, place, time_order
from ..operators.quantiles import smallest_cut
from ..operators.ranking import benign_reference
from ..operators.summary import batch_summary, combined_source_summary, summarize
from ..schema import SUBSPACE_RANK
from ..session import scratch_path

MIN_BATCH = 100
_LOG_SCHEMA = ("batch_id long, phase string, threshold double, relearn_status string, candidates long, "
               "memory_rows long, model_version long, memory_version long")


@dataclass(frozen=True)
class AdaptiveSettings:
    batch_size: int = 1000
    warmup_batches: int = 1
    memory_size: int | None = None
    contamination: float = 0.08
    rank: int = SUBSPACE_RANK
    key: str = "flow_id"
    exclude_flagged: bool = False

    @property
    def size(self) -> int:
        return max(MIN_BATCH, self.batch_size)

    @property
    def memory(self) -> int:
        return self.memory_size or self.size * 5

    @property
    def minimum_relearn(self) -> int:
        return max(MIN_BATCH, self.size // 20)


@dataclass(frozen=True)
class StepLog:
    """What one step did and which state versions the next one starts from."""

    batch_id: int
    phase: str
    threshold: float
    relearn_status: str
    candidates: int
    memory_rows: int
    model_version: int
    memory_version: int


def latest_by_position(rows: DataFrame, count: int, total: int) -> DataFrame:
    """The latest ``count`` rows by (slice, position): whole slices from the end, the first of them cut by counting.

    Positions need to be comparable within a slice only.
    """
    if total <= count:
        return rows
    left = count
    for row in rows.groupBy("slice_id").agg(F.count("*").alias("n")).orderBy(F.desc("slice_id")).toLocalIterator():
        if row["n"] >= left:
            break
        left -= row["n"]
    first, size = row["slice_id"], row["n"]
    if left == size:
        return rows.filter(F.col("slice_id") >= first)
    part = rows.filter(F.col("slice_id") == first)
    cut = smallest_cut(part, -F.col("position"), {None: left}, {None: size})[None]
    return rows.filter((F.col("slice_id") > first) | ((F.col("slice_id") == first) & (F.col("position") >= -int(cut))))


class AdaptiveLearner:
    """One adaptive run below ``root``; ``step`` takes batches in order."""

    def __init__(self, spark: SparkSession, root: str, settings: AdaptiveSettings):
        self.spark, self.root, self.settings = spark, root, settings
        self._model: tuple[int, FlowBaselineModel] | None = None

    # -- versioned state ---------------------------------------------------
    def _estimator(self) -> FlowBaseline:
        return FlowBaseline(self.settings.contamination, self.settings.rank)

    def _path(self, kind: str, version: int) -> str:
        return f"{self.root}/{kind}/batch_id={version}"

    def _load_model(self, version: int) -> FlowBaselineModel:
        if self._model is None or self._model[0] != version:
            self._model = (version, FlowBaselineModel.load(self.spark, f"{self.root}/model/v{version}"))
        return self._model[1]

    def _learn(self, version: int, memory: DataFrame, persist_model: bool) -> None:
        model = self._estimator().fit(memory, StorageLevel.MEMORY_AND_DISK)
        if persist_model:
            model.save(f"{self.root}/model/v{version}")
        self._model = (version, model)

    def _write(self, kind: str, version: int, table: DataFrame) -> DataFrame:
        path = self._path(kind, version)
        table.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(table.schema).parquet(path)

    def _log(self, entry: StepLog) -> StepLog:
        table = self.spark.createDataFrame([tuple(asdict(entry).values())], _LOG_SCHEMA)
        table.coalesce(1).write.mode("overwrite").parquet(self._path("log", entry.batch_id))
        return entry

    def checkpoint_epoch(self, epoch: int, warm_seen: int, batch_id: int) -> None:
        """Remember how far a stream got: warm-up slices seen and last batch written."""
        table = self.spark.createDataFrame([(warm_seen, batch_id)], "warm_seen long, batch_id long")
        table.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/epochs/epoch={epoch}")

    def epoch_state(self, epoch: int) -> tuple[int, int]:
        if epoch < 0:
            return 0, 0
        row = self.spark.read.schema("warm_seen long, batch_id long").parquet(f"{self.root}/epochs/epoch={epoch}").first()
        return row["warm_seen"], row["batch_id"]

    def last_epoch(self) -> int:
        """The latest micro-batch that was finished, -1 if none was."""
        epochs = self.spark.read.schema("warm_seen long, batch_id long, epoch long").parquet(f"{self.root}/epochs")
        return epochs.agg(F.coalesce(F.max("epoch"), F.lit(-1))).first()[0]

    def logged(self, batch_id: int) -> StepLog:
        row = self.spark.read.schema(_LOG_SCHEMA).parquet(self._path("log", batch_id)).first()
        return StepLog(**row.asDict())

    # -- steps ---------------------------------------------------------------
    def warmup(self, batch: DataFrame, persist_model: bool = True) -> StepLog:
        """Fit on the benign part of the first batches and score all of them as batch 1."""
        flow_columns = batch.columns
        reference = benign_reference(batch, True, self.settings.key).select(*flow_columns)
        self._learn(1, reference, persist_model)
        scored = self._score(batch, 1, "warmup")
        rows = reference.count()
        memory = latest_by_position(reference, self.settings.memory, rows)
        self._write("memory", 1, memory)
        return self._log(StepLog(1, "warmup", scored[1], "warmup", rows,
                                 min(rows, self.settings.memory), 1, 1))

    def _score(self, batch: DataFrame, batch_id: int, phase: str) -> tuple[DataFrame, float]:
        model = self._model[1]
        result = model.transform(batch, storage_level=StorageLevel.MEMORY_AND_DISK)
        stored = self._write("scored", batch_id, result.withColumn("learning_phase", F.lit(phase)))
        model.release()
        return stored, float(model.scoring_thresholds[None])

    def step(self, batch: DataFrame, batch_id: int, before: StepLog, persist_model: bool = True) -> StepLog:
        """Score one batch, then decide whether and from what to relearn."""
        settings, flow_columns = self.settings, batch.columns
        self._load_model(before.model_version)
        scored, threshold = self._score(batch, batch_id, "adapt")
        candidates = benign_reference(scored, False, settings.key, exclude_flagged=settings.exclude_flagged)
        count = candidates.count()
        if count == 0:
            candidates = scored.filter(~F.col("is_anomaly"))
            count = candidates.count()
        labelled = "label" in batch.columns
        if count == 0 or (labelled and count < settings.minimum_relearn):
            return self._log(StepLog(batch_id, "adapt", threshold, "skipped", count, before.memory_rows,
                                     before.model_version, before.memory_version))
        held = self.spark.read.schema(batch.schema).parquet(self._path("memory", before.memory_version))
        pooled = held.unionByName(candidates.select(*flow_columns))
        total = before.memory_rows + count
        memory = self._write("memory", batch_id, latest_by_position(pooled, settings.memory, total))
        self._learn(batch_id, memory, persist_model)
        return self._log(StepLog(batch_id, "adapt", threshold, "updated", count,
                                 min(total, settings.memory), batch_id, batch_id))

    # -- results ----------------------------------------------------------------
    def scored(self) -> DataFrame:
        table = self.spark.read.option("basePath", f"{self.root}/scored").parquet(f"{self.root}/scored")
        return table.withColumn("batch_id", F.col("batch_id").cast("long"))

    def log_table(self) -> DataFrame:
        return self.spark.read.schema(_LOG_SCHEMA).parquet(f"{self.root}/log")

    def batch_summaries(self) -> DataFrame:
        """One row per batch with its threshold and relearn decision."""
        log = self.log_table().select("batch_id", F.round("threshold", 4).alias("threshold"), "relearn_status")
        return batch_summary(self.scored()).join(F.broadcast(log), "batch_id")

    def summary(self, with_classes: bool = False) -> DataFrame:
        """The overall summary with the batch counts and the last threshold."""
        log = self.log_table().agg(
            F.count("*").alias("adaptive_batches"),
            F.count_if(F.col("relearn_status") == "skipped").alias("skipped_relearn_batches"),
            F.max_by("threshold", "batch_id").alias("final_threshold")).first()
        warm = self.scored().filter(F.col("learning_phase") == "warmup").agg(F.count_distinct("slice_id")).first()[0]
        return summarize(self.scored(), with_classes=with_classes).withColumns({
            "warmup_batches": F.lit(warm).cast("long"),
            "memory_size": F.lit(self.settings.memory).cast("long"),
            **{name: F.lit(log[name]) for name in log.asDict()}})


def adaptive_run(flows: DataFrame, settings: AdaptiveSettings = AdaptiveSettings(),
                 root: str | None = None) -> AdaptiveLearner:
    """Adaptive scoring of a canonical flow table in time order.

    The flows are written once in order; every step reads the row range of
    its batch only. Choose ``batch_size`` so that the number of batches stays
    in the thousands.
    """
    placed = place(flows, time_order(settings.key))
    if not placed.total:
        raise ValueError("no flows for adaptive learning")
    return _run_range(placed, 0, placed.total, settings, root)


def _run_range(placed: PlacedTable, start: int, rows: int, settings: AdaptiveSettings, root: str | None = None) -> AdaptiveLearner:
    """Adaptive scoring of ``rows`` rows of a placed table from ``start`` on; positions count from there."""
    spark, size = placed.stored.sparkSession, settings.size
    slices = -(-rows // size)

    def batch(first: int, stop: int) -> DataFrame:
        found = placed.rows(start + first * size, start + min(stop * size, rows))
        return found.withColumn("position", F.col("position") - start).withColumn("slice_id", F.floor(F.col("position") / size).cast("long"))

    learner = AdaptiveLearner(spark, root or scratch_path(spark, "adaptive"), settings)
    warm = min(max(1, settings.warmup_batches), slices)
    log = learner.warmup(batch(0, warm), persist_model=False)
    for batch_id, slice_id in enumerate(range(warm, slices), start=2):
        log = learner.step(batch(slice_id, slice_id + 1), batch_id, log, persist_model=False)
    return learner


def adaptive_per_source(flows: DataFrame, settings: AdaptiveSettings = AdaptiveSettings(),
                        by: str = "dataset_source", parallel: int = 4) -> tuple[DataFrame, DataFrame]:
    """An adaptive run per source: scored rows of all sources and their batch summaries.

    The flows are written once, ordered by source and time, and every step of
    every source reads a row range of that. Sources are independent, so their
    jobs share the cluster side by side.
    """
    placed = place(flows, [F.col(by).asc_nulls_first(), *time_order(settings.key)])
    # one row per source, as the driver runs each
    ranges = placed.rows().groupBy(by).agg(F.min("position").alias("start"), F.count(F.lit(1)).alias("rows")).orderBy("start").collect()

    def run(source) -> AdaptiveLearner:
        return _run_range(placed, source["start"], source["rows"], settings)

    with ThreadPoolExecutor(parallel) as pool:
        learners = list(pool.map(run, ranges))
    scored = reduce(lambda a, b: a.unionByName(b), [one.scored() for one in learners])
    summaries = reduce(lambda a, b: a.unionByName(b), [
        one.batch_summaries().withColumn(by, F.lit(source[by])) for one, source in zip(learners, ranges)])
    return scored, summaries


def combined_summary(scored: DataFrame, summaries: DataFrame, contamination: float = 0.08,
                     by: str = "dataset_source") -> DataFrame:
    """One summary of the adaptive runs of all sources, with each source's last threshold."""
    last = summaries.groupBy(by).agg(F.max_by("threshold", "batch_id").alias("threshold"))
    return combined_source_summary(scored, last, contamination, by)
