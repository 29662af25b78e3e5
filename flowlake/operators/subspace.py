"""Leading directions of the centred feature matrix, by distributed QR.

Each task reduces its rows to one small triangular factor; the factors are
merged in a tree, so what moves is ``partitions x 20 x 20`` numbers however
many rows there are. A Gram matrix would be cheaper but squares the condition
number, and features with a tiny MAD differ by a factor of a million.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_DRIVER_FACTORS = 1024   # factors the driver merges itself
_MERGE_FANOUT = 64


def _stack(r: np.ndarray | None, block: np.ndarray) -> np.ndarray:
    return np.linalg.qr(block if r is None else np.vstack([r, block]), mode="r")


def triangular_factors(df: DataFrame, vector: list[Column], by: str | None) -> DataFrame:
    """One row per task and group: the R factor of the rows seen there."""
    width = len(vector)
    names = [f"v{i}" for i in range(width)]
    data = df.select(F.col(by).cast("string").alias("_group") if by else F.lit("").alias("_group"),
                     F.spark_partition_id().alias("_task"),
                     *[c.cast("double").alias(n) for c, n in zip(vector, names)])

    def reduce_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors: dict[str | None, np.ndarray] = {}
        task = 0
        for batch in batches:
            if batch.num_rows == 0:
                continue
            task = batch.column(1)[0].as_py()
            matrix = np.column_stack([batch.column(i + 2).to_numpy() for i in range(width)])
            groups = batch.column(0)
            if by is None:
                factors[""] = _stack(factors.get(""), matrix)
                continue
            codes = groups.dictionary_encode()
            index = codes.indices.fill_null(-1).to_numpy()
            for code in np.unique(index):
                key = codes.dictionary[int(code)].as_py() if code >= 0 else None
                factors[key] = _stack(factors.get(key), matrix[index == code])
        if factors:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(factors), pa.string()), pa.array([task] * len(factors), pa.int64()),
                 pa.array([r.ravel() for r in factors.values()], pa.list_(pa.float64()))],
                names=["_group", "_task", "r"])

    return data.mapInArrow(reduce_rows, "_group string, _task long, r array<double>")


def _merge_on_executors(factors: DataFrame, width: int) -> DataFrame:
    def merge(table: pa.Table) -> pa.Table:
        r = None
        for flat in table.column("r").to_pylist():
            r = _stack(r, np.asarray(flat).reshape(-1, width))
        return pa.table({"_group": table.column("_group")[:1].cast(pa.string()),
                         "_task": table.column("_task")[:1].cast(pa.int64()),
                         "r": pa.array([r.ravel()], pa.list_(pa.float64()))})

    bucket = F.pmod(F.hash("_task"), F.lit(_MERGE_FANOUT))
    return (factors.groupBy("_group", bucket)
            .applyInArrow(merge, "_group string, _task long, r array<double>"))


def merged_factors(df: DataFrame, vector: list[Column], by: str | None = None,
                   tasks: int = 1, groups: int = 1) -> dict[str | None, np.ndarray]:
    """The R factor per group (text form of the group key; ``None`` without groups)."""
    width = len(vector)
    factors = triangular_factors(df, vector, by)
    if tasks * groups > _DRIVER_FACTORS:
        factors = _merge_on_executors(factors, width)
    merged: dict[str | None, np.ndarray] = {}
    for row in sorted(factors.collect(), key=lambda r: r["_task"]):
        key = row["_group"] if by else None
        merged[key] = _stack(merged.get(key), np.asarray(row["r"]).reshape(-1, width))
    return merged


def leading_directions(r: np.ndarray, rank: int) -> tuple[np.ndarray, np.ndarray]:
    """Top right singular vectors (sign fixed) and all singular values."""
    _, values, vt = np.linalg.svd(r, full_matrices=False)
    top = vt[:min(rank, len(values))]
    signs = np.sign(top[np.arange(len(top)), np.abs(top).argmax(axis=1)]) if len(top) else np.ones(0)
    return top * signs[:, None], values
