"""Counts, top-k, tails and reference selections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import hash_key
from ..functions.text import is_known_attack, is_known_normal
from ..schema import MIN_BENIGN_ROWS, SIGNATURE_COLUMNS
from .quantiles import smallest_cut

#: Microseconds beyond any timestamp, exact as a double.
_AFTER_ALL = float(1 << 53)


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("count"))


def top_value(df: DataFrame, column: str) -> DataFrame:
    """Most frequent value; the smallest one of a tie."""
    return value_counts(df, column).orderBy(F.desc("count"), column).limit(1)


def sorted_by_score(scored: DataFrame, key: str = "flow_id") -> DataFrame:
    return scored.orderBy(F.desc("anomaly_score"), key)


def best_per_signature(scored: DataFrame, keys: list[str], key: str) -> DataFrame:
    """Highest scoring row per signature, the smallest key of a tie, as a map-side combining minimum."""
    rest = [c for c in scored.columns if c not in (*keys, "anomaly_score", key)]
    score = F.col("anomaly_score")
    best = F.min(F.struct(score.isNull().alias("none"), (-score).alias("down"), F.col(key).alias("key"), score.alias("score"),
                          F.struct(*rest).alias("rest") if rest else F.lit(0).alias("rest"))).alias("best")
    return scored.groupBy(*keys).agg(best).select(
        *keys, F.col("best.score").alias("anomaly_score"), F.col("best.key").alias(key), *([F.col("best.rest.*")] if rest else []))


def top_hits(scored: DataFrame, count: int = 5, key: str = "flow_id") -> DataFrame:
    """The highest scoring flows, one per flow signature.

    Signatures are aggregated over their key columns alone; the other columns
    are fetched for the ``count`` rows that are found.
    """
    keys = [c for c in SIGNATURE_COLUMNS if c in scored.columns]
    order = [F.desc("anomaly_score"), F.col(key)]
    if not keys:
        return scored.dropDuplicates().orderBy(*order).limit(count)
    narrow = best_per_signature(scored.select(*keys, "anomaly_score", key), keys, key)
    found = narrow.orderBy(*order).limit(count).select(key)
    rows = scored.join(F.broadcast(found), key, "left_semi")
    return best_per_signature(rows, keys, key).orderBy(*order).limit(count).select(*scored.columns)


def lowest_scores(scored: DataFrame, count: int, key: str = "flow_id") -> DataFrame:
    """The ``count`` rows with the smallest scores (``count`` is a small constant)."""
    return scored.orderBy("anomaly_score", key).limit(count)


def latest_rows(flows: DataFrame, count: int, key: str = "flow_id") -> DataFrame:
    """The last ``count`` rows in time order: nulls last, ``key`` (a number) settles equal times.

    Two cuts found by counting, of the time and of the keys at that time; no
    sort of the table.
    """
    total = flows.count()
    if total <= count:
        return flows
    time = F.coalesce(F.unix_micros(F.col("timestamp")).cast("double"), F.lit(_AFTER_ALL))
    cut = -smallest_cut(flows, -time, {None: count}, {None: total})[None]
    later, same = flows.filter(time > cut), flows.filter(time == cut)
    left = count - later.count()
    keys = -F.col(key)
    last = smallest_cut(same, keys, {None: left}, {None: same.count()})[None]
    return flows.filter((time > cut) | ((time == cut) & (keys <= last)))


def limit_rows(df: DataFrame, max_rows: int | None, key: str, seed: int = 42) -> DataFrame:
    """A seeded sample of exactly ``max_rows`` rows, or all if there are fewer.

    The cut is the ``max_rows``-th smallest hash, found by counting, so the
    sample is a plain filter: no global sort and no single-task limit.
    """
    if max_rows is None or max_rows <= 0:
        return df
    total = df.count()
    if total <= max_rows:
        return df
    hashed = hash_key(F.col(key), seed)
    cut = smallest_cut(df, hashed, {None: max_rows}, {None: total})[None]
    return df.filter(hashed <= int(cut))


def benign_reference(flows: DataFrame, full_fallback: bool = False, key: str = "flow_id",
                     minimum: int = MIN_BENIGN_ROWS, exclude_flagged: bool = False) -> DataFrame:
    """Rows a model may learn from.

    Enough known normal rows stand alone; a few are topped up with the lowest
    scoring rows that are no known attacks; without any, the whole table or
    nothing. Unlabelled tables are used whole unless ``exclude_flagged``.
    """
    if "label" not in flows.columns:
        if exclude_flagged and "is_anomaly" in flows.columns:
            return flows.filter(~F.col("is_anomaly"))
        return flows
    normal = flows.filter(is_known_normal(F.col("label")))
    found = normal.count()
    if found >= minimum:
        return normal
    if found and "anomaly_score" in flows.columns:
        pool = flows.filter(~is_known_attack(F.col("label")))
        extra = lowest_scores(pool, minimum - found, key)
        return normal.unionByName(extra).dropDuplicates()
    return flows if full_fallback else flows.limit(0)


def union_tagged(tables: dict[str, DataFrame], column: str = "dataset_source") -> DataFrame:
    """Union by name with the table name as provenance column."""
    result: DataFrame | None = None
    for name, table in tables.items():
        tagged = table.withColumn(column, F.lit(name))
        result = tagged if result is None else result.unionByName(tagged, allowMissingColumns=True)
    if result is None:
        raise ValueError("no tables to union")
    return result


