"""Row positions over a total order, without a single-task window."""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

_LOCAL_BITS = 33  # monotonically_increasing_id keeps the row counter in the low 33 bits


def time_order(key: str, timestamp: str = "timestamp") -> list[Column]:
    """Time order with nulls last; ``key`` settles equal timestamps."""
    return [F.col(timestamp).asc_nulls_last(), F.col(key).asc()]


@dataclass(frozen=True)
class PlacedTable:
    """A table written in order, with the first position of every task that wrote it."""

    stored: DataFrame
    parts: list[int]
    starts: list[int]
    total: int

    def _mark(self, position: int) -> int:
        """The stored row mark of a position."""
        i = bisect_right(self.starts, position) - 1
        return (self.parts[i] << _LOCAL_BITS) + position - self.starts[i]

    def rows(self, first: int = 0, stop: int | None = None, name: str = "position") -> DataFrame:
        """The rows at positions ``first <= p < stop`` with their position.

        Row marks grow with the position, so the range is a filter on a stored
        column whose file statistics skip everything outside of it.
        """
        table = self.stored
        if self.total:
            if first > 0:
                table = table.filter(F.col("_mark") >= self._mark(min(first, self.total)))
            if stop is not None and stop < self.total:
                table = table.filter(F.col("_mark") < self._mark(stop))
        offsets = table.sparkSession.createDataFrame(
            list(zip(self.parts, self.starts)), "_part long, _offset long")
        local = F.col("_mark").bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1))
        return (table.withColumn("_part", F.shiftright("_mark", _LOCAL_BITS))
                .join(F.broadcast(offsets), "_part")
                .withColumn(name, F.col("_offset") + local)
                .drop("_part", "_mark", "_offset"))


def place(df: DataFrame, order_by: list[Column] | None = None) -> PlacedTable:
    """Order a table by range partitioning and write it once to the shared folder.

    A unique last sort column lets the range partitioner split even a
    timestamp that holds most of the rows. Without ``order_by`` the input
    order is kept.
    """
    if order_by:
        df = df.repartitionByRange(*order_by).sortWithinPartitions(*order_by)
    stored = cut_lineage(df.withColumn("_mark", F.monotonically_increasing_id()), "placed")
    # One row per task that wrote the table: bounded by the partition count.
    counts = (stored.groupBy(F.shiftright("_mark", _LOCAL_BITS).alias("part"))
              .agg(F.count("*").alias("rows")).orderBy("part").collect())
    starts, total = [], 0
    for row in counts:
        starts.append(total)
        total += row["rows"]
    return PlacedTable(stored, [row["part"] for row in counts], starts, total)


def with_position(df: DataFrame, order_by: list[Column] | None = None,
                  name: str = "position") -> DataFrame:
    """Add the 0-based position of each row."""
    return place(df, order_by).rows(name=name)


def assign_batches(df: DataFrame, batch_size: int, key: str, timestamp: str = "timestamp",
                   minimum: int = 100) -> DataFrame:
    """Tumbling batches of ``batch_size`` rows over the time order (0-based ``slice_id``)."""
    size = max(minimum, batch_size)
    placed = with_position(df, time_order(key, timestamp))
    return placed.withColumn("slice_id", F.floor(F.col("position") / size).cast("long"))
