"""Batch-hard triplet loss over bounded batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARGIN = 0.3


def hardest_triplets(vectors: np.ndarray, labels: np.ndarray):
    """Anchors with their farthest same-class and nearest other-class row."""
    similarity = np.clip(vectors @ vectors.T, -1.0, 1.0)
    same = labels[:, None] == labels[None, :]
    others = ~same
    np.fill_diagonal(same, False)
    anchors = np.flatnonzero(same.any(axis=1) & others.any(axis=1))
    positive = np.where(same, similarity, np.inf).argmin(axis=1)[anchors]
    negative = np.where(others, similarity, -np.inf).argmax(axis=1)[anchors]
    return anchors, positive, negative, similarity


def batch_loss(vectors: np.ndarray, labels: np.ndarray, margin: float = MARGIN) -> tuple[int, float]:
    """Anchors that count and their mean loss (0 without any)."""
    anchors, positive, negative, similarity = hardest_triplets(vectors, labels)
    if not len(anchors):
        return 0, 0.0
    gap = similarity[anchors, negative] - similarity[anchors, positive] + margin
    return len(anchors), float(np.maximum(gap, 0.0).mean())


def triplet_loss(df: DataFrame, batch: str, label: str = "label", vector: str = "embedding",
                 margin: float = MARGIN) -> DataFrame:
    """``batch, anchors, loss`` for every batch.

    ``batch`` must number bounded mini-batches (positions or hashes cut to
    size): a batch is one matrix in one task, and its pairs never leave it.
    """
    data = df.select(F.col(batch).cast("long").alias("batch"), F.col(label).cast("string").alias("label"),
                     F.col(vector).alias("v"))

    def one_batch(table: pa.Table) -> pa.Table:
        column = table.column("v").combine_chunks()
        vectors = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
        anchors, loss = batch_loss(vectors, np.array(table.column("label").to_pylist(), dtype=object), margin)
        return pa.table({"batch": table.column("batch")[:1].cast(pa.int64()),
                         "anchors": pa.array([anchors], pa.int64()),
                         "loss": pa.array([loss], pa.float64())})

    return data.groupBy("batch").applyInArrow(one_batch, "batch long, anchors long, loss double")
