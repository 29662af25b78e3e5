"""Labels, class filters, splits and class-balanced resampling."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import hash_key, hash_unit
from ..session import cut_lineage
from .params import GroupParams, small_or_written
from .positions import with_position
from .quantiles import smallest_cut

_COPIES_PER_STEP = 10_000
#: Most classes whose counts are kept on the driver.
COUNTED_CLASSES = 10_000


def training_labels(flows: DataFrame, name: str = "training_label") -> DataFrame:
    """The best label at hand: traffic class, label, protocol, or ``unknown``."""
    for source in ("traffic_class", "label", "protocol"):
        if source in flows.columns:
            return flows.withColumn(name, F.col(source).cast("string"))
    return flows.withColumn(name, F.lit("unknown"))


def class_counts(df: DataFrame, label: str) -> dict[object, int]:
    return {r[label]: r["n"] for r in df.groupBy(label).agg(F.count("*").alias("n")).collect()}


def label_index(df: DataFrame, label: str, name: str = "label_index") -> DataFrame:
    """0-based index of each label in sorted order; a null label has none."""
    # The unpartitioned window sees one row per class, not the table.
    classes = df.select(label).distinct().filter(F.col(label).isNotNull()).withColumn(
        name, F.row_number().over(Window.orderBy(label)) - 1)
    table, small = small_or_written(classes, "classes")
    return df.join(F.broadcast(table) if small else table, label, "left")


def classes_with_at_least(df: DataFrame, label: str, minimum: int = 2) -> DataFrame:
    """Rows whose class has at least ``minimum`` rows."""
    kept = df.groupBy(label).agg(F.count("*").alias("n")).filter(F.col("n") >= minimum).select(label)
    table, small = small_or_written(kept, "classes")
    return df.join(F.broadcast(table) if small else table, label, "left_semi")


def stratified_split(df: DataFrame, label: str, key: str, test_fraction: float = 0.2,
                     seed: int = 42, name: str = "is_test") -> DataFrame:
    """Mark ``ceil(test_fraction * n)`` rows of every class as test rows.

    Each class is cut at its exact k-th smallest seeded hash, so a class may
    be of any size: by counting for up to ``COUNTED_CLASSES`` classes, by the
    position within the class for more. If a class has a single row the split
    ignores classes. Rows without a label are a class; an empty table stays empty.
    """
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    classes, least, total = sizes.agg(F.count(F.lit(1)), F.min("n"), F.sum("n")).first()
    if not classes:
        return df.withColumn(name, F.lit(False))
    hashed = hash_key(F.col(key), seed)
    if least < 2:
        cut = smallest_cut(df, hashed, {None: math.ceil(test_fraction * total)}, {None: total})[None]
        return df.withColumn(name, hashed <= int(cut))
    if classes > COUNTED_CLASSES:
        placed = cut_lineage(with_position(df, [F.col(label).asc_nulls_first(), hashed, F.col(key)], "_position"), "placed")
        firsts = placed.groupBy(F.col(label).alias("_class")).agg(
            F.min("_position").alias("_first"), F.ceil(F.count(F.lit(1)) * test_fraction).alias("_wanted"))
        within = F.col("_position") - F.col("_first")
        return placed.join(firsts, F.col(label).eqNullSafe(F.col("_class"))).withColumn(name, within < F.col("_wanted")).select(*df.columns, name)
    counts = class_counts(df, label)
    wanted = {c: math.ceil(test_fraction * n) for c, n in counts.items()}
    cuts = smallest_cut(df, hashed, wanted, counts, by=label)
    joined, get = GroupParams(label, {c: {"cut": cut} for c, cut in cuts.items()}).attach(df)
    return GroupParams.detach(joined.withColumn(name, hashed <= F.expr(get("cut"))))


def balanced_resample(df: DataFrame, label: str, key: str, draws: int | None = None,
                      seed: int = 42) -> DataFrame:
    """``draws`` draws with replacement (as many as rows by default): a class at random, then one of its rows.

    Every draw has two seeded random numbers of its own, one for the class and one for the row's place in it, so the
    numbers of draws are multinomial and add up exactly. Draws of the same row are counted before they are shuffled: a
    class of one row gets its many draws as one number. ``draw`` numbers the copies of a row. Rows without a label are a
    class, the first one; the order of rows that share a key is any.
    """
    placed = cut_lineage(with_position(df, [F.col(label).asc_nulls_first(), F.col(key).asc_nulls_first()], "_position"), "placed")
    classes = placed.groupBy(F.col(label).alias("_class")).agg(F.min("_position").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    ranked, small = small_or_written(with_position(classes, [F.col("_first").asc()], "_rank"), "classes")
    rows, count = ranked.agg(F.coalesce(F.sum("_rows"), F.lit(0)), F.count(F.lit(1))).first()
    if not rows:
        return df.withColumn("draw", F.lit(1).cast("long"))
    drawn = df.sparkSession.range(rows if draws is None else draws).select(
        F.floor(hash_unit(F.col("id"), seed) * count).alias("_rank"), hash_unit(F.col("id"), seed + 1).alias("_unit"))
    places = (drawn.join(F.broadcast(ranked) if small else ranked, "_rank")
              .groupBy((F.col("_first") + F.floor(F.col("_unit") * F.col("_rows"))).alias("_position")).agg(F.count(F.lit(1)).alias("_copies")))
    counted = placed.join(places, "_position").drop("_position")
    # A tiny class repeats its rows very often: the steps are spread over tasks first.
    steps = counted.withColumn("_from", F.explode(F.sequence(
        F.lit(1).cast("long"), F.col("_copies"), F.lit(_COPIES_PER_STEP).cast("long"))))
    spread = steps.repartition(F.col(key), F.col("_from"))
    last = F.least(F.col("_copies"), F.col("_from") + (_COPIES_PER_STEP - 1))
    return (spread.withColumn("draw", F.explode(F.sequence(F.col("_from"), last)))
            .drop("_copies", "_from"))
