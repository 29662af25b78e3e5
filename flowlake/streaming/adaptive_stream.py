"""Adaptive scoring of a flow stream, one micro-batch at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.positions import time_order, with_position
from ..plans.adaptive import AdaptiveLearner, AdaptiveSettings
from ..session import cut_lineage, drop_scratch

#: Keeps the keys on the executors' disks; the default provider keeps all of them in memory.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def first_deliveries(stream: DataFrame, key: str, remember: str | None = None) -> DataFrame:
    """The flows of a stream whose key was not delivered before, however late they arrive.

    The keys are the state of a streaming deduplication, partitioned by key: a micro-batch looks up its own keys and
    nothing else, whatever was seen before. ``remember`` ("30 days") lets a key go that long after its flow arrived,
    by the clock and not by the flows' own times, so that no flow is ever too late; by default keys stay for good.
    Flows without a key all count; each leaves an entry of its own in the state.
    """
    told_apart = stream.withColumn("_unkeyed", F.when(F.col(key).isNull(), F.uuid()))
    if remember is None:
        return told_apart.dropDuplicates([key, "_unkeyed"]).drop("_unkeyed")
    arrived = told_apart.withColumn("_arrived", F.current_timestamp()).withWatermark("_arrived", remember)
    return arrived.dropDuplicatesWithinWatermark([key, "_unkeyed"]).drop("_unkeyed", "_arrived")


def start_adaptive_stream(stream: DataFrame, root: str, settings: AdaptiveSettings = AdaptiveSettings(),
                          remember: str | None = None, **trigger) -> StreamingQuery:
    """Score canonical flows as they arrive, relearning after every micro-batch.

    Results and state are tables below ``root``. State versions are keyed by
    the micro-batch id: a replayed micro-batch starts from the version before
    it and overwrites its own output, so every flow is scored exactly once.
    Re-sent flows are told by ``first_deliveries``. The flows of the warm-up are
    scored when its last slice is there; ``score_available`` does not wait for it.
    """
    learner = AdaptiveLearner(stream.sparkSession, root, settings)
    warm = max(1, settings.warmup_batches)

    def on_batch(batch: DataFrame, epoch: int) -> None:
        warm_seen, last = learner.epoch_state(epoch - 1)
        new = cut_lineage(batch, "micro")  # the one run of the stateful plan
        if not new.isEmpty():
            # positions count within the micro-batch, which is the slice
            placed = with_position(new, time_order(settings.key)).withColumn("slice_id", F.lit(epoch).cast("long"))
            if warm_seen < warm:
                learner._write("warmup", warm_seen, placed)
                warm_seen += 1
                if warm_seen == warm:
                    last = learner.warmup(_warmup_slices(learner, warm, placed)).batch_id
            else:
                last = learner.step(placed, last + 1, learner.logged(last)).batch_id
        learner.checkpoint_epoch(epoch, warm_seen, last)
        drop_scratch(new)

    writer = (first_deliveries(stream, settings.key, remember).writeStream.foreachBatch(on_batch)
              .option("checkpointLocation", f"{root}/offsets").trigger(**(trigger or {"availableNow": True})))
    conf, name = stream.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(name)
    conf.set(name, STATE_STORE)  # a query takes the settings that hold when it starts
    try:
        return writer.start()
    finally:
        conf.set(name, before)


def _warmup_slices(learner: AdaptiveLearner, count: int, like: DataFrame | None = None) -> DataFrame:
    paths = [f"{learner.root}/warmup/batch_id={i}" for i in range(count)]
    reader = learner.spark.read
    return (reader.schema(like.schema) if like else reader).parquet(*paths)


def finish_warmup(spark: SparkSession, root: str, settings: AdaptiveSettings = AdaptiveSettings()) -> bool:
    """Fit on and score the slices of a warm-up that the stream ended in; a later run goes on from there.

    Returns whether there was such a warm-up.
    """
    learner, warm = AdaptiveLearner(spark, root, settings), max(1, settings.warmup_batches)
    epoch = learner.last_epoch()
    warm_seen, _ = learner.epoch_state(epoch)
    if not 0 < warm_seen < warm:
        return False
    log = learner.warmup(_warmup_slices(learner, warm_seen))
    learner.checkpoint_epoch(epoch, warm, log.batch_id)
    return True


def score_available(stream: DataFrame, root: str, settings: AdaptiveSettings = AdaptiveSettings(),
                    remember: str | None = None) -> None:
    """Score all flows that are there now and return; none stays behind in an unfinished warm-up."""
    start_adaptive_stream(stream, root, settings, remember).awaitTermination()
    finish_warmup(stream.sparkSession, root, settings)
