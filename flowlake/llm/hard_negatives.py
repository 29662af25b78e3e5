"""Hard negatives: for anchors and their best rows of the same label, the best rows of other labels in a score window.

Rows are range-partitioned on the coordinate that spreads most and packed into R-trees (``rtree``) in blocks. Anchors go
out in blocks of bounded size; every task searches its trees for each of them, best node first. A node's box gives the
interval of its inner products; nodes outside of an anchor's windows and nodes strictly below its k-th best so far are
passed over. The k best so far go along from tree to tree of a task, and a task returns at most these, so what is shuffled
is bounded by tasks, anchors and k. A first search finds the positives, a second one all windows of their scores at once.

Edge cases: rows with a null label, a null vector or a null, NaN or infinite component take no part; of vectors of
several lengths those of the commonest length do, of equally common ones the longest; components too large for exact
sums of squares in doubles are an error that names the bound; a row is never its own positive, but others of the same
id are; rows with a null id are no anchors and come last among equal scores; repeated anchors each give their rows; an
anchor without positives, a positive without negatives and negative positive scores, whose window is empty, give no row;
an empty table gives an empty result; further columns are left aside.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlake.llm.rtree import Wanted, best_first, packing_order, tree_of
from flowlake.llm.vector_codes import as_lists, finite, gathered, matrix, of_one_length, scaled
from flowlake.session import cut_lineage, scratch_path

SCALE = 256
#: Rows of one tree, and of one task on average.
BLOCK = 16_384
TASK_ROWS = 1 << 18
#: Anchors that are sent out at once (a block of one task's anchors has half of it at most).
ANCHORS = 16_384


class Rule(NamedTuple):
    """How many positives and negatives, and the window in hundredths of the positive's score."""
    positives: int = 5
    negatives: int = 3
    low: int = 50
    high: int = 95


class Anchors(NamedTuple):
    """A block of anchors: number, row, label, vector; in the second search also the windows of each, sorted by anchor:
    (first window by anchor, low, high)."""
    number: np.ndarray
    row: np.ndarray
    label: np.ndarray
    vector: np.ndarray
    windows: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None


def _spreads(length: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows, total, square = 0, np.zeros(length), np.zeros(length)
    for batch in batches:
        found = matrix(batch.column(0), length).astype(np.float64)
        rows, total, square = rows + len(found), total + found.sum(0), square + (found ** 2).sum(0)
    yield pa.RecordBatch.from_pydict({"rows": [rows], "total": [total.tolist()], "square": [square.tolist()]})


def _widest(rows: DataFrame, length: int) -> tuple[int, int]:
    """The number of rows and the coordinate of the largest variance."""
    found = rows.select("vector").mapInArrow(partial(_spreads, length), "rows long, total array<double>, square array<double>").agg(
        F.sum("rows"), *[F.sum(F.col(c)[k]) for c in ("total", "square") for k in range(length)]).first()
    if not found[0]:
        return 0, 0
    total, square = np.array(found[1:1 + length]) / found[0], np.array(found[1 + length:]) / found[0]
    return found[0], int((square - total ** 2).argmax())


def _packed(length: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in gathered(batches, BLOCK):
        points = matrix(table.column("vector"), length)
        order = packing_order(points)
        table = table.take(pa.array(order))
        yield pa.RecordBatch.from_arrays(
            [*(as_lists(table.column(c)) for c in ("row", "id", "label")), pa.array([points[order].astype(np.int32).tobytes()], pa.binary())],
            ["rows", "ids", "labels", "points"])


def packed_trees(rows: DataFrame, length: int) -> DataFrame:
    """One row per tree: rows, ids, labels and vectors in packing order; written."""
    count, widest = _widest(rows, length)
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, -(-count // TASK_ROWS))
    lead = F.col("vector")[widest]
    dealt = rows.repartitionByRange(tasks, lead, F.xxhash64("row")).sortWithinPartitions(lead, "row")  # the hash divides equal values
    return cut_lineage(dealt.mapInArrow(partial(_packed, length), "rows array<long>, ids array<long>, labels array<long>, points binary"), "trees")


def _searched(shared, rule: Rule, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    anchors: Anchors = shared.value
    second = anchors.windows is not None
    if second:
        first, low, high = anchors.windows
        wanted = [[Wanted(a, b, rule.negatives) for a, b in zip(low[i:j].tolist(), high[i:j].tolist())] for i, j in zip(first, first[1:])]
    else:
        wanted = [[Wanted(-np.inf, np.inf, rule.positives)] for _ in anchors.number]
    asked = [k for k, w in enumerate(wanted) if w]
    for batch in batches:
        for rows, ids, labels, points in zip(*batch.columns):
            rows, labels, ids = rows.values.to_numpy(), labels.values.to_numpy(), ids.values.to_pylist()
            tree = tree_of(np.frombuffer(points.as_py(), np.int32).reshape(len(rows), -1))
            same = {label: labels == label for label in np.unique(anchors.label).tolist()}
            for part in (asked[k:k + 256] for k in range(0, len(asked), 256)):
                lows, highs = tree.intervals(anchors.vector[part])
                for k, low, high in zip(part, lows.tolist(), highs.tolist()):
                    usable = same[int(anchors.label[k])]
                    usable = ~usable if second else usable & (rows != anchors.row[k])
                    best_first(tree, anchors.vector[k], low, high, wanted[k], usable, ids)
    found = [(k, w, -score, row_id if known == 0 else None) for k in asked for w, wish in enumerate(wanted[k]) for score, known, row_id in wish.found]
    if found:
        k, window, score, row_id = zip(*found)
        yield pa.RecordBatch.from_arrays([pa.array(anchors.number[list(k)], pa.int64()), pa.array(window, pa.int32()), pa.array(score, pa.int64()),
                                          pa.array(row_id, pa.int64())], ["number", "window", "score", "id"])


def _best(trees: DataFrame, anchors: Anchors, rule: Rule, most: int) -> DataFrame:
    """(number, window, rank, score, id): the best of all tasks."""
    shared = trees.sparkSession.sparkContext.broadcast(anchors)
    found = trees.mapInArrow(partial(_searched, shared, rule), "number long, window int, score long, id long")
    order = Window.partitionBy("number", "window").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def _blocks(anchors: DataFrame) -> Iterator[tuple[int, int]]:
    """Ranges of anchor numbers with at most ``ANCHORS`` anchors; a number is the task's number and a running one."""
    size, held, start, last = ANCHORS // 2, 0, None, None
    chunk = F.floor(F.col("number") / size)  # the running number has 33 bits, so a chunk is of one task
    for r in anchors.groupBy(chunk.alias("chunk")).agg(F.count(F.lit(1)).alias("n"), F.min("number").alias("a"), F.max("number").alias("b")).orderBy("a").toLocalIterator():
        if start is not None and held + r["n"] > ANCHORS:
            yield start, last
            start, held = None, 0
        start = r["a"] if start is None else start
        held, last = held + r["n"], r["b"]
    if start is not None:
        yield start, last


def hard_negatives(rows: DataFrame, is_anchor: Column, label: Column, rule: Rule = Rule(), id_col: str = "vec_id",
                   vector_col: str = "embedding") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``label`` is a whole number and may be made of the row's columns; ``is_anchor`` names the rows to ask for.
    """
    spark, vector = rows.sparkSession, F.col(vector_col)
    usable = rows.filter(finite(vector) & label.isNotNull()).select(
        F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), scaled(vector, SCALE).alias("vector"),
        F.coalesce(is_anchor, F.lit(False)).alias("is_anchor"))
    kept, length = of_one_length(usable, "vector", 1)
    kept = cut_lineage(kept.withColumn("row", F.monotonically_increasing_id()), "rows")
    trees = packed_trees(kept, length)
    anchors = cut_lineage(kept.filter("is_anchor").withColumn("number", F.monotonically_increasing_id()), "anchors")
    path = scratch_path(spark, "negatives")
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    spark.createDataFrame([], schema).write.parquet(path)
    for low, high in _blocks(anchors):
        block = anchors.filter(F.col("number").between(low, high)).orderBy("number").toArrow()  # at most ANCHORS rows
        number, row, group = (block.column(c).to_numpy() for c in ("number", "row", "label"))
        asked = Anchors(number, row, group, matrix(block.column("vector"), length).astype(np.float64))
        positives = _best(trees, asked, rule, rule.positives).orderBy("number", "rank").toArrow()  # a few rows per anchor
        score = positives.column("score").to_numpy()
        least, most = -(-rule.low * score // 100), rule.high * score // 100
        of = np.searchsorted(number, positives.column("number").to_numpy())
        windows, which = np.unique(np.stack([of, least, most], 1)[least <= most], axis=0, return_inverse=True)
        first = np.searchsorted(windows[:, 0], np.arange(len(number) + 1)) if len(windows) else np.zeros(len(number) + 1, int)
        asked = asked._replace(windows=(first, windows[:, 1], windows[:, 2]))
        ids = block.column("id")
        pairs = pa.table({"number": pa.array(number[of]), "anchor_id": ids.take(pa.array(of)), "positive_id": positives.column("id"),
                          "positive_score": positives.column("score")}).filter(pa.array(least <= most))
        own = of[least <= most]
        pairs = pairs.append_column("window", pa.array(which.reshape(-1) - first[own], pa.int32()))
        found = _best(trees, asked, rule, rule.negatives).withColumnsRenamed({"id": "negative_id", "score": "negative_score"})
        met = found.join(F.broadcast(spark.createDataFrame(pairs)), ["number", "window"])
        met.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


def query(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows, F.col("vec_id") % 50 == 0, label)


SQL = f"""
WITH kept AS MATERIALIZED (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor({SCALE} * x::DOUBLE) FOR x IN embedding] AS v,
           row_number() OVER () AS r
    FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([1 FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
usable AS MATERIALIZED (SELECT * FROM kept WHERE len(v) = (SELECT len(v) FROM kept GROUP BY 1 ORDER BY count(*) DESC, 1 DESC LIMIT 1)),
scored AS MATERIALIZED (SELECT a.r, a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
    FROM usable a JOIN usable b ON a.r <> b.r WHERE a.vec_id % 50 = 0),
positives AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, other_id NULLS LAST) AS k FROM scored WHERE same QUALIFY k <= 5)
SELECT p.anchor_id, p.other_id AS positive_id,
       (row_number() OVER (PARTITION BY p.r, p.k ORDER BY n.score DESC, n.other_id NULLS LAST))::INTEGER AS rank,
       n.other_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON n.r = p.r AND NOT n.same AND 100 * n.score BETWEEN 50 * p.score AND 95 * p.score
QUALIFY rank <= 3
"""
