"""Sending only the rows on that a hash table may concern."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of the map that is broadcast (8 MB at any size of the input).
ROUTE_BITS = 1 << 26
_BITMAP_BITS = 32_768


def routed(df: DataFrame, column: str, hashes: DataFrame, hash_column: str) -> DataFrame:
    """``df`` with ``_routed``, true for all rows whose ``column`` is among ``hash_column`` of ``hashes`` and few others.

    It says whether the row's bit is set in a map of all hashes. The map has a fixed number of bits, so it may
    be broadcast; the more hashes there are, the more other rows share a bit, and whoever asks must check them.
    """
    def bit(name: str) -> Column:
        return F.pmod(F.col(name), F.lit(ROUTE_BITS))

    buckets = (hashes.select(bit(hash_column).alias("_bit"))
               .groupBy(F.floor(F.col("_bit") / _BITMAP_BITS).alias("_bucket"))
               .agg(F.bitmap_construct_agg(F.col("_bit") % _BITMAP_BITS).alias("_bits")))
    within = bit(column) % _BITMAP_BITS
    byte = F.conv(F.hex(F.col("_bits").substr(F.floor(within / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return (df.withColumn("_bucket", F.floor(bit(column) / _BITMAP_BITS))
            .join(F.broadcast(buckets), "_bucket", "left")
            .withColumn("_routed", F.coalesce(F.getbit(byte, (within % 8).cast("int")) == 1, F.lit(False)))
            .drop("_bucket", "_bits"))


def numbered(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with columns c0, c1, .., which clash with no name that an operator adds, and the new name of each
    column. ``toDF(*df.columns)`` undoes it."""
    names = [f"c{k}" for k in range(len(df.columns))]
    return df.toDF(*names), dict(zip(df.columns, names))


def without_ids(df: DataFrame, id_col: str, dropped: DataFrame) -> DataFrame:
    """The rows of ``df`` whose id is not in ``dropped`` (one column of that name). Only rows that the map lets
    through are shuffled; rows without an id stay."""
    plain, name = numbered(df)
    own = name[id_col]
    ids = dropped.select(F.col(id_col).alias(own)).distinct()
    marked = routed(plain.withColumn("_hash", F.xxhash64(own)), "_hash", ids.select(F.xxhash64(own).alias("_hash")), "_hash")
    checked = marked.filter("_routed").join(ids, own, "left_anti")
    return marked.filter("NOT _routed").select(plain.columns).unionByName(checked.select(plain.columns)).toDF(*df.columns)
