"""Cosine similarity within and between classes, in one pass over the vectors.

The mean over all pairs follows from the vector sum of each class, so no pair
is ever formed: ``sum_{i<j} u_i.u_j = (|sum u|^2 - sum |u|^2) / 2``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import dot, norm, vector_sum
from ..schema import TARGET_ACCURACY, TARGET_INTER, TARGET_INTRA
from ..session import cut_lineage
from .knn import PivotIndex, pivots_pay
from .params import small_or_written
from .tiles import pairs

#: Probe vectors of one broadcast.
PROBE_BYTES = 32 << 20
#: Classes of a block when class pairs are formed.
CLASS_BLOCK = 512


def unit_vectors(df: DataFrame, vector: str = "embedding", name: str = "unit") -> DataFrame:
    length = F.greatest(norm(F.col(vector)), F.lit(1e-8))
    return (df.withColumn("_length", length)
            .withColumn(name, F.transform(vector, lambda x: x.cast("double") / F.col("_length")))
            .drop("_length"))


def class_sums(df: DataFrame, label: str = "label", vector: str = "embedding",
               size: int = 64) -> DataFrame:
    """Rows, vector sum and summed squared length per class."""
    units = unit_vectors(df.select(label, vector), vector)
    return units.groupBy(label).agg(
        F.count("*").alias("n"), vector_sum(F.col("unit"), size).alias("total"),
        F.sum(dot(F.col("unit"), F.col("unit"))).alias("squares"))


def intra_class(sums: DataFrame, label: str = "label") -> DataFrame:
    """Mean cosine over the pairs of a class; 1 for a class of one row."""
    n = F.col("n")
    pairs = (dot(F.col("total"), F.col("total")) - F.col("squares")) / (n * (n - 1))
    return sums.select(label, F.when(n < 2, 1.0).otherwise(pairs).alias("intra_cosine"))


def inter_class(sums: DataFrame, label: str = "label", block: int = CLASS_BLOCK) -> DataFrame:
    """Mean cosine between every two classes.

    Classes are dealt to blocks of about ``block``; every two blocks meet in one task, in which each pair is formed once.
    """
    blocks = max(1, -(-sums.count() // block))
    own = F.pmod(F.xxhash64(label), F.lit(blocks)).cast("int")
    side = sums.select(F.struct(F.col(label).alias("label")).alias("key"), "n", "total", own.alias("own"),
                       F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("other"))
    a, b = side.alias("a"), side.alias("b")
    met = a.join(b, (F.col("a.own") == F.col("b.other")) & (F.col("a.other") == F.col("b.own")) & (F.col("a.key") < F.col("b.key")))
    mean = dot(F.col("a.total"), F.col("b.total")) / (F.col("a.n") * F.col("b.n"))
    return met.select(F.col("a.key.label").alias("class_a"), F.col("b.key.label").alias("class_b"), mean.alias("inter_cosine"))


def mean_inter_class(sums: DataFrame, size: int = 64) -> DataFrame:
    """The mean of :func:`inter_class` over all pairs, from the sum of the classes' means; null for fewer than two classes."""
    means = sums.select(F.transform("total", lambda x: x / F.col("n")).alias("mean"))
    row = means.agg(F.count(F.lit(1)).alias("n"), vector_sum(F.col("mean"), size).alias("total"), F.sum(dot(F.col("mean"), F.col("mean"))).alias("squares"))
    pairs = (dot(F.col("total"), F.col("total")) - F.col("squares")) / (F.col("n") * (F.col("n") - 1))
    return row.select(F.when(F.col("n") > 1, pairs).alias("inter_cosine"))


def cosine_join(df: DataFrame, threshold: float, key: str = "vec_id", vector: str = "embedding", block: int | None = None) -> DataFrame:
    """(id, other, cosine) of all pairs of rows with a cosine of at least ``threshold``, the smaller id first.

    Rows are laid out by pivots (:class:`~flowlake.operators.knn.PivotIndex`); a row meets only those blocks that the
    triangle inequality does not put farther away than the threshold. Where it would leave out too little, every two blocks
    meet tile by tile (:mod:`~flowlake.operators.tiles`). Ids are unique.
    """
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"), F.lit(None).cast("string").alias("label"))
    count, width = rows.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    given = rows.select("id", "v")
    if block or pivots_pay(given, count, rows, count, distance=1.0 - threshold):
        return PivotIndex.of(rows, count, block).within(given, 1.0 - threshold)
    return pairs(given, 1.0 - threshold, count, width)


def cosine_to(df: DataFrame, probes: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Cosine similarity of every row with each probe row.

    Probes are a stated query set: they are broadcast in blocks of at most
    ``PROBE_BYTES``, however many there are. The full similarity matrix of a
    table is quadratic and only ever needed for the class means above.
    """
    units = unit_vectors(df.select(key, vector), vector).select(key, "unit")
    listed = cut_lineage(unit_vectors(probes.select(F.col(key).alias("probe"), vector), vector).select("probe", F.col("unit").alias("p")), "probes")
    size = listed.agg(F.sum(F.size("p") * 8 + 64)).first()[0] or 0
    blocks = max(1, -(-size // PROBE_BYTES))
    found = None
    for block in range(blocks):
        part = listed.filter(F.pmod(F.xxhash64("probe"), F.lit(blocks)) == block).withColumn("_all", F.lit(0))
        each = units.withColumn("_all", F.lit(0)).join(F.broadcast(part), "_all").select(
            key, "probe", dot(F.col("unit"), F.col("p")).alias("cosine"))
        found = each if found is None else found.unionByName(each)
    return found


def embedding_kpis(df: DataFrame, accuracy: float | None = None, label: str = "label",
                   vector: str = "embedding", size: int = 64) -> DataFrame:
    """Unweighted means over classes and class pairs, and whether they meet the targets."""
    sums, _ = small_or_written(class_sums(df, label, vector, size), "class_sums")
    intra = intra_class(sums, label).agg(F.avg("intra_cosine").alias("value")).withColumn("kpi", F.lit("intra"))
    inter = mean_inter_class(sums, size).select(F.col("inter_cosine").alias("value"), F.lit("inter").alias("kpi"))
    table = intra.unionByName(inter).groupBy().pivot("kpi", ["intra", "inter"]).agg(F.first("value"))
    result = table.select(
        F.coalesce("intra", F.lit(0.0)).alias("mean_intra"),
        F.coalesce("inter", F.lit(0.0)).alias("mean_inter")).withColumns({
            "intra_ok": F.col("mean_intra") >= TARGET_INTRA,
            "inter_ok": F.col("mean_inter") <= TARGET_INTER})
    if accuracy is not None:
        result = result.withColumns({"accuracy": F.lit(accuracy),
                                     "accuracy_ok": F.lit(accuracy >= TARGET_ACCURACY)})
    return result
