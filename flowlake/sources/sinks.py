"""Writers of flow tables, batch summaries and embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import EXPORT_ID_COLUMNS


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_batch_summary(summaries: DataFrame, path: str) -> None:
    """The batch summaries of an adaptive run as one CSV file, in batch order."""
    write_csv(summaries.orderBy("batch_id").coalesce(1), path)


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    df.write.mode("overwrite").partitionBy(*(partition_by or [])).parquet(path)


def embeddings_wide(df: DataFrame, vector: str = "embedding", size: int = 64,
                    id_columns: list[str] | None = None) -> DataFrame:
    """Identity columns that exist, then ``emb_0 .. emb_<size-1>``."""
    names = id_columns or [c for c in EXPORT_ID_COLUMNS if c in df.columns]
    return df.select(*names, *[F.col(vector)[i].alias(f"emb_{i}") for i in range(size)])
