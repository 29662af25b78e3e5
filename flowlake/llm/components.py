"""Connected components of an edge table that stays distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlake.session import cut_lineage, drop_scratch


def _nearest(pairs: DataFrame) -> DataFrame:
    """(u, v, m) with m the least of u and its neighbours v. The minimum is combined before it is shuffled."""
    least = pairs.groupBy("u").agg(F.min("v").alias("_m")).select("u", F.least("u", "_m").alias("m"))
    return pairs.join(least, "u")


def components(edges: DataFrame) -> DataFrame:
    """(node, component): for each node of ``edges`` (u long, v long) the least node that it is connected with.

    Alternates two steps until nothing changes: every node ties its larger neighbours, then its smaller ones,
    to the least node of its neighbourhood. Stars stay stars, chains halve. Self loops and repeated edges are
    allowed; null ends are left out. Each round is written, so a lost executor repeats one round at most.
    """
    now = cut_lineage(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                      .filter("u IS NOT NULL AND v IS NOT NULL AND u <> v").distinct(), "edges")
    state = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _nearest(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        small = _nearest(large)  # here u is the larger end of every edge
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            small.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        after = cut_lineage(small, "edges")
        row = after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        drop_scratch(now)
        now = after
        if state == tuple(row):
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        state = tuple(row)
