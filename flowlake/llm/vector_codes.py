"""Product codes of vectors: integer k-means of vector parts over metric trees with cached sums.

A vector's components become integers and are cut into ``PARTS`` equal parts. Every task builds, for each part position
of blocks of its rows, a metric tree (``metric_tree``) once and writes it down. Each round of k-means sends the codebooks
to the trees: candidate entries are handed down and shrink on the way, a ball that one entry owns whole adds its cached
sum and count, and a task returns one row per part position and entry. The last walk returns codes and errors row by row.

Only codebooks (``PARTS`` times ``ENTRIES`` entries at most) reach the driver; rows are moved once, when an input has fewer
splits than cores. Errors per label are summed task by task first; labels that hold a thousandth of all rows and more, a
thousand at most, get their sum by broadcast, the others by a join.

Edge cases: rows whose vector is null or holds a null, NaN or infinite component take no part; of vectors of several
lengths those of the commonest length do, of equally common ones the longest; a length that is no multiple of
``PARTS`` and components too large for exact sums of squares in doubles (2^21 after scaling for 64 components) are errors
that name the bound; rows with a null id come last among the starting entries, rows that share an id in the order of their
vectors; repeated rows all count; fewer than ``ENTRIES`` rows give as many entries, equal ones included, of which the
first is used; null labels are one label; an empty table gives an empty result; further columns are left aside.
"""

from __future__ import annotations

import hashlib
import io
import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlake.llm import metric_tree
from flowlake.session import cut_lineage, spread

SCALE = 1024
PARTS = 4
ENTRIES = 256
ROUNDS = 4
#: Rows of one tree.
BLOCK = 8192
#: A label with at least one in so many rows gets its sum by broadcast.
HOT_SHARE = 1000


def finite(vector: Column) -> Column:
    """Whether a vector and all of its components are there and finite."""
    return vector.isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(math.inf)))


def scaled(vector: Column, scale: int) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale))


def of_one_length(rows: DataFrame, vector: str, parts: int) -> tuple[DataFrame, int]:
    """The rows whose integer vector has the commonest length, and this length; checks that doubles hold their squares."""
    lengths = rows.groupBy(F.size(vector).alias("length")).agg(
        F.count(F.lit(1)).alias("rows"), F.max(F.array_max(F.transform(vector, F.abs))).alias("largest")).collect()
    if not lengths:
        return rows, 0
    _, length, largest = max((r["rows"], r["length"], r["largest"] or 0) for r in lengths)
    if length % parts:
        raise ValueError(f"vectors of {length} components cannot be cut into {parts} equal parts")
    if largest > squares_bound(length):
        raise ValueError(f"a scaled component is {largest}; vectors of {length} components may have {squares_bound(length)} at most")
    return rows.filter(F.size(vector) == length), length


def squares_bound(length: int) -> int:
    """The largest component with which four times a sum of ``length`` squares is below 2^53."""
    return math.isqrt((1 << 51) // max(length, 1))


def gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """The batches as tables of ``rows`` rows; the last one may have fewer."""
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        while batch.num_rows:
            part = batch.slice(0, rows - count)
            held.append(part)
            count += part.num_rows
            batch = batch.slice(part.num_rows)
            if count == rows:
                yield pa.Table.from_batches(held).combine_chunks()
                held, count = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def matrix(column: pa.ChunkedArray, length: int) -> np.ndarray:
    """A list column whose lists all have ``length`` values, as a matrix."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = lists.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), length)


def as_lists(column: pa.ChunkedArray) -> pa.Array:
    """All values of a column as the one list of a one-row column."""
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _packed(arrays: list[np.ndarray]) -> bytes:
    target = io.BytesIO()
    np.savez(target, *arrays)
    return target.getvalue()


def _unpacked(content: bytes) -> list[np.ndarray]:
    with np.load(io.BytesIO(content), allow_pickle=False) as found:
        return [found[f"arr_{k}"] for k in range(len(found.files))]


def _tree_bytes(points: np.ndarray) -> bytes:
    tree = metric_tree.build(points)
    small = [a.astype(np.int32) for a in (points, tree.order, tree.first, tree.end, tree.left, tree.right)]
    return _packed([*small, tree.radius, tree.total])


def _tree(content: bytes) -> tuple[metric_tree.MetricTree, np.ndarray]:
    points, *shape, radius, total = _unpacked(content)
    order, first, end, left, right = (a.astype(np.int64) for a in shape)
    center = total / (end - first)[:, None]
    return metric_tree.MetricTree(order, first, end, left, right, center, radius, total), points.astype(np.int64)


def _grown(length: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in gathered(batches, BLOCK):
        parts = np.split(matrix(table.column(2), length), PARTS, axis=1)
        yield pa.RecordBatch.from_arrays(
            [as_lists(table.column(0)), as_lists(table.column(1)), pa.array([[_tree_bytes(p) for p in parts]], pa.list_(pa.binary()))],
            ["ids", "labels", "trees"])


def _moved(shared, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    codebooks: np.ndarray = shared.value
    total, count = np.zeros(codebooks.shape, np.int64), np.zeros(codebooks.shape[:2], np.int64)
    for batch in batches:
        for trees in batch.column(0):
            for part, content in enumerate(trees.as_py()):
                tree, points = _tree(content)
                walk = metric_tree.nearest(tree, points, codebooks[part])
                np.add.at(total[part], walk.owners, tree.total[walk.balls])
                np.add.at(count[part], walk.owners, (tree.end - tree.first)[walk.balls])
                np.add.at(total[part], walk.entries, points[walk.points])
                np.add.at(count[part], walk.entries, 1)
    part, entry = np.nonzero(count)
    yield pa.RecordBatch.from_pydict({
        "part": pa.array(part.astype(np.int32)), "entry": pa.array(entry.astype(np.int32)), "rows": pa.array(count[part, entry]),
        "total": pa.array(list(total[part, entry]), pa.list_(pa.int64()))})


def _coded(shared, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    codebooks: np.ndarray = shared.value
    for batch in batches:
        for ids, labels, trees in zip(*batch.columns):
            rows = len(ids.values)
            error, codes = np.zeros(rows, np.int64), np.zeros((rows, PARTS), np.uint8)
            for part, content in enumerate(trees.as_py()):
                tree, points = _tree(content)
                walk = metric_tree.nearest(tree, points, codebooks[part])
                entry = np.zeros(rows, np.int64)
                entry[walk.points] = walk.entries
                for ball, owner in zip(walk.balls, walk.owners):
                    entry[tree.order[tree.first[ball]:tree.end[ball]]] = owner
                error += ((points - codebooks[part][entry]) ** 2).sum(1)
                codes[:, part] = entry
            text = codes.tobytes().hex()
            yield pa.RecordBatch.from_arrays(
                [ids.values, labels.values, pa.array([text[k:k + 2 * PARTS] for k in range(0, len(text), 2 * PARTS)], pa.string()), pa.array(error)],
                ["vec_id", "label", "code", "error"])


def _codebooks(trees: DataFrame, start: np.ndarray) -> np.ndarray:
    codebooks, width = start, start.shape[2]
    for _ in range(ROUNDS):
        shared = trees.sparkSession.sparkContext.broadcast(codebooks)
        sums = trees.select("trees").mapInArrow(partial(_moved, shared), "part int, entry int, rows long, total array<long>")
        # one row per part position and entry
        found = sums.groupBy("part", "entry").agg(F.sum("rows"), *[F.sum(F.col("total")[k]) for k in range(width)]).collect()
        shared.unpersist()
        codebooks = codebooks.copy()
        for part, entry, rows, *total in found:
            codebooks[part, entry] = np.array(total, np.int64) // rows
    return codebooks


def with_label_sums(rows: DataFrame) -> DataFrame:
    """``rows`` (written) with ``label_error``, the sum of ``error`` over the rows of the same label."""
    sums = cut_lineage(rows.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("_rows")), "labels")
    total = sums.agg(F.sum("_rows")).first()[0] or 0
    is_hot = F.col("_rows") * HOT_SHARE >= total  # at most HOT_SHARE labels
    met = rows.join(F.broadcast(sums.filter(is_hot)), F.col("label").eqNullSafe(F.col("_label")), "left")
    own = [*rows.columns, "label_error"]
    cold = sums.filter(~is_hot)
    if cold.isEmpty():
        return met.select(own)
    rest = met.filter("_rows IS NULL").select(rows.columns).join(cold, F.col("label").eqNullSafe(F.col("_label")))
    return met.filter("_rows IS NOT NULL").select(own).unionByName(rest.select(own))


def vector_codes(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, code, error) of every usable row, written, and the codebooks (part position x entry x component)."""
    vector = F.col(vector_col)
    usable = rows.filter(finite(vector)).select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), scaled(vector, SCALE).alias("vector"))
    kept, length = of_one_length(usable, "vector", PARTS)
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(ENTRIES).select("vector").collect()
    start = np.array([r["vector"] for r in first], np.int64).reshape(len(first), PARTS, length // PARTS).transpose(1, 0, 2)
    kinds = [rows.schema[c].dataType.simpleString() for c in (id_col, label_col)]
    trees = cut_lineage(spread(kept).mapInArrow(partial(_grown, length), f"ids array<{kinds[0]}>, labels array<{kinds[1]}>, trees array<binary>"), "trees")
    codebooks = _codebooks(trees, start) if len(first) else start
    shared = rows.sparkSession.sparkContext.broadcast(codebooks)
    coded = trees.mapInArrow(partial(_coded, shared), f"vec_id {kinds[0]}, label {kinds[1]}, code string, error long")
    return cut_lineage(coded, "codes"), codebooks


def codebooks_digest(codebooks: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, codebooks.reshape(-1).tolist())).encode()).hexdigest()


def query(spark, sf_dir: str) -> DataFrame:
    coded, codebooks = vector_codes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return with_label_sums(coded).select("vec_id", "code", "error", "label_error", F.lit(codebooks_digest(codebooks)).alias("codebooks_sha256"))


def _round_sql(step: int) -> str:
    return f"""
a{step} AS MATERIALIZED (SELECT r, p, any_value(q) AS q, min(struct_pack(d := list_inner_product(q, q) - 2 * list_inner_product(q, e)
           + list_inner_product(e, e), k := k)) AS best
       FROM parts JOIN b{step} USING (p) GROUP BY r, p)"""


def _books_sql(step: int) -> str:
    return f"""
b{step} AS MATERIALIZED (SELECT o.p, o.k, coalesce(n.e, o.e) AS e FROM b{step - 1} o LEFT JOIN (
         SELECT p, k, list(((s - ((s % c) + c) % c) // c)::DOUBLE ORDER BY i) AS e
         FROM (SELECT p, k, i, sum(x::BIGINT)::BIGINT AS s, count(*) AS c
               FROM (SELECT p, best.k AS k, unnest(q) AS x, generate_subscripts(q, 1) AS i FROM a{step - 1}) GROUP BY p, k, i)
         GROUP BY p, k) n ON n.p = o.p AND n.k = o.k)"""


SQL = f"""
WITH fit AS MATERIALIZED (SELECT vec_id, label, [floor({SCALE} * x::DOUBLE) FOR x IN embedding] AS v FROM embeddings
             WHERE embedding IS NOT NULL AND len([1 FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
kept AS MATERIALIZED (SELECT *, row_number() OVER () AS r, len(v) // {PARTS} AS w FROM fit
     WHERE len(v) = (SELECT len(v) FROM fit GROUP BY 1 ORDER BY count(*) DESC, 1 DESC LIMIT 1)),
parts AS MATERIALIZED (SELECT r, p, v[p * w + 1:(p + 1) * w] AS q FROM kept, (SELECT unnest(range({PARTS})) AS p)),
b0 AS MATERIALIZED (SELECT p, k, q AS e FROM parts JOIN (
         SELECT r, row_number() OVER (ORDER BY vec_id NULLS LAST, v) - 1 AS k FROM kept QUALIFY k < {ENTRIES}) USING (r)),
""" + ",".join(_round_sql(k) + "," + _books_sql(k + 1) for k in range(ROUNDS)) + "," + _round_sql(ROUNDS) + f""",
coded AS (SELECT vec_id, label, string_agg(printf('%02x', best.k), '' ORDER BY p) AS code, sum(best.d)::BIGINT AS error
     FROM a{ROUNDS} JOIN kept USING (r) GROUP BY r, vec_id, label)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
     (SELECT sha256(string_agg(x::BIGINT, ',' ORDER BY p, k, i))
      FROM (SELECT p, k, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM b{ROUNDS})) AS codebooks_sha256
FROM coded
"""
