"""Classification quality from a confusion table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def confusion_matrix(df: DataFrame, truth: str = "truth", predicted: str = "predicted") -> DataFrame:
    return df.groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(
        F.count("*").alias("n"))


def _ratio(part, whole):
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def classification_report(confusion: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per class and averaged, and the accuracy.

    Works on the confusion table, so its size depends on the classes only.
    """
    hit = F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0)
    sides = confusion.select(F.inline(F.array(
        F.struct(F.col("truth").alias("class"), hit.alias("hits"), F.col("n").alias("support"),
                 F.lit(0).cast("long").alias("claimed")),
        F.struct(F.col("predicted").alias("class"), F.lit(0).cast("long").alias("hits"),
                 F.lit(0).cast("long").alias("support"), F.col("n").alias("claimed")))))
    totals = sides.groupBy("class").agg(*[F.sum(c).alias(c) for c in ("hits", "support", "claimed")])
    precision, recall = _ratio(F.col("hits"), F.col("claimed")), _ratio(F.col("hits"), F.col("support"))
    scored = totals.select("class", precision.alias("precision"), recall.alias("recall"), "support", "hits")
    classes = scored.withColumn("f1", _ratio(2 * F.col("precision") * F.col("recall"),
                                             F.col("precision") + F.col("recall")))
    measures = ["precision", "recall", "f1"]
    weight = F.sum("support")
    macro = classes.agg(*[F.avg(m).alias(m) for m in measures], weight.alias("support"))
    weighted = classes.agg(*[_ratio(F.sum(F.col(m) * F.col("support")), weight).alias(m) for m in measures],
                           weight.alias("support"))
    accuracy = classes.agg(*[_ratio(F.sum("hits"), weight).alias(m) for m in measures],
                           weight.alias("support"))
    result = classes.select("class", *measures, "support")
    for name, table in (("accuracy", accuracy), ("macro avg", macro), ("weighted avg", weighted)):
        result = result.unionByName(table.withColumn("class", F.lit(name)))
    return result


def accuracy(df: DataFrame, truth: str = "truth", predicted: str = "predicted") -> float:
    return df.agg(F.avg((F.col(truth) == F.col(predicted)).cast("double"))).first()[0]
