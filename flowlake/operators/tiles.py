"""Inner products of two vector tables, tile by tile.

A tile is searched in single precision with an allowance for its rounding. What may count is computed again pair by pair in
double precision, so equal vectors have equal distances wherever they lie.

Whole tables meet as blocks of some thousand rows, which are written once. In a Cartesian product a task reads a few blocks
of one table and those of a bounded part of the other, so no copies of rows are shuffled and no task holds more than that.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

#: Rows and bytes of a block at most.
BLOCK_ROWS = 4096
BLOCK_BYTES = 4 << 20
#: Bytes of the blocks that one task holds of the right table, and of a file of blocks.
SIDE_BYTES = 32 << 20
FILE_BYTES = 16 << 20
_ROWS = 256
_CELLS = 1 << 21
_PAIRS = 32_768

NEIGHBOURS = "array<struct<distance:double,id:long,label:string>>"


def unit(flat: np.ndarray, rows: int) -> np.ndarray:
    """Rows as unit vectors; those of length zero stay."""
    table = flat.astype(np.float64).reshape(rows, -1) if rows else np.zeros((0, 0))
    lengths = np.linalg.norm(table, axis=1, keepdims=True) if rows else 1.0
    return table / np.maximum(lengths, 1e-8)


def _slack(width: int) -> float:
    """More than twice the rounding of an inner product of unit vectors in single precision."""
    return (width + 8) * 2.4e-7


def _cosines(left: np.ndarray, right: np.ndarray, row: np.ndarray, col: np.ndarray) -> np.ndarray:
    """Of pairs, each one summed in the same order."""
    step = max(1, _CELLS // left.shape[1])
    return np.concatenate([np.zeros(0), *(np.einsum("ij,ij->i", left[row[s:s + step]], right[col[s:s + step]]) for s in range(0, len(row), step))])


def _true(table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``nonzero`` of a table with few true cells; eight at a time are looked at first."""
    flat = table.ravel()
    if flat.size % 8:
        found = np.flatnonzero(flat)
    else:
        words = np.flatnonzero(flat.view(np.uint64))
        found = (words[:, None] * 8 + np.arange(8))[flat.reshape(-1, 8)[words]]
    return np.divmod(found, table.shape[1])


class Nearest:
    """The k nearest rows so far of every row of ``test``, by distance and id."""

    def __init__(self, test: np.ndarray, k: int):
        self.test, self.single, self.k = test, test.astype(np.float32), k
        self.bound = np.full(len(test), np.inf)
        nothing = (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, object))
        self.found = [nothing for _ in range(0, len(test), _ROWS)]  # row, distance, id, label

    def meet(self, train: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> Nearest:
        """Take in ``train``; any number of rows."""
        for low in range(0, len(train), BLOCK_ROWS):
            self._meet(train[low:low + BLOCK_ROWS], ids[low:low + BLOCK_ROWS], labels[low:low + BLOCK_ROWS])
        return self

    def _meet(self, train: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> None:
        opposite, slack, take = -train.astype(np.float32).T, _slack(train.shape[1]), min(self.k, len(train)) - 1
        for part, low in enumerate(range(0, len(self.test), _ROWS)):
            bound = self.bound[low:low + _ROWS]
            away = self.single[low:low + _ROWS] @ opposite
            edge = bound - 1.0
            fresh = np.isinf(bound)
            if fresh.any():  # no k rows yet: those of this tile bound them
                kth = np.partition(away[fresh], take, axis=1)[:, take]
                edge[fresh] = np.where(np.isnan(kth), np.inf, kth)
            row, col = _true(away <= (edge + slack).astype(np.float32)[:, None])
            if len(row):
                self._take(part, bound, row, 1.0 - _cosines(self.test[low:low + _ROWS], train, row, col), ids[col], labels[col])

    def _take(self, part: int, bound: np.ndarray, *more: np.ndarray) -> None:
        row, distance, ids, labels = (np.concatenate(c) for c in zip(self.found[part], more))
        order = np.lexsort((ids, distance, row))
        sorted_rows = row[order]
        order = order[np.arange(len(order)) - np.searchsorted(sorted_rows, sorted_rows) < self.k]
        self.found[part] = row, distance, *_ = tuple(c[order] for c in (row, distance, ids, labels))
        counts = np.bincount(row, minlength=len(bound))
        full = counts == self.k
        bound[full] = distance[np.cumsum(counts)[full] - 1]

    def lists(self) -> pa.ListArray:
        """The neighbours of each row of ``test``."""
        counts = [np.bincount(f[0], minlength=min(_ROWS, len(self.test) - part * _ROWS)) for part, f in enumerate(self.found)]
        distances, ids, labels = (np.concatenate(c) for c in list(zip(*self.found))[1:]) if self.found else ([], [], [])
        struct = pa.StructArray.from_arrays([pa.array(distances, pa.float64()), pa.array(ids).cast(pa.int64()), pa.array(labels, pa.string())],
                                            names=["distance", "id", "label"])
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], *counts]).cumsum(), pa.int32()), struct)


def close(left: np.ndarray, right: np.ndarray, distance: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, row, cosine) of all pairs at most ``distance`` away (1 - cosine), ``_PAIRS`` at most at a time."""
    for start in range(0, len(right), BLOCK_ROWS):
        other = right[start:start + BLOCK_ROWS]
        turned, edge = other.astype(np.float32).T, np.float32(1.0 - distance - _slack(right.shape[1]))
        for low in range(0, len(left), _ROWS):
            some = left[low:low + _ROWS]
            rows, cols = _true(some.astype(np.float32) @ turned >= edge)
            for s in range(0, len(rows), _PAIRS):
                row, col = rows[s:s + _PAIRS], cols[s:s + _PAIRS]
                cosine = _cosines(some, other, row, col)
                near = 1.0 - cosine <= distance
                yield row[near] + low, col[near] + start, cosine[near]


def _kind(df: DataFrame) -> str:
    return "float32" if df.schema["v"].dataType.elementType.simpleString() == "float" else "float64"


def _blocks(df: DataFrame, rows: int, width: int, name: str) -> DataFrame:
    """``df`` (id, v, label) written as ``block, ids, labels, v``, numbers as bytes; a task packs its rows in their order."""
    kind = np.dtype(_kind(df))
    row_bytes = max(1, width) * kind.itemsize
    most = max(1, min(BLOCK_ROWS, BLOCK_BYTES // row_bytes))

    def block(number: int, held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        n, v = table.num_rows, np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in table.column("v").chunks]).astype(kind)
        if len(v) != n * width:
            raise ValueError(f"{n} vectors of {width} components have {len(v)} in all")
        ids = table.column("id").cast(pa.int64()).to_numpy()
        labels = pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), pa.array(table.column("label").to_pylist(), pa.string()))
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([ids.tobytes()]), labels, pa.array([v.tobytes()])], names=["block", "ids", "labels", "v"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, count = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            low = 0
            while low < batch.num_rows:
                held.append(batch.slice(low, most - count))
                low, count = low + held[-1].num_rows, count + held[-1].num_rows
                if count == most:
                    yield block(number, held)
                    number, held, count = number + 1, [], 0
        if count:
            yield block(number, held)

    parts = max(df.sparkSession.sparkContext.defaultParallelism, -(-rows * row_bytes // FILE_BYTES))
    packed = df.select("id", "v", "label").coalesce(parts).mapInArrow(pack, "block long, ids binary, labels array<string>, v binary")
    return cut_lineage(packed, name, per_file=max(1, FILE_BYTES // (most * row_bytes)))


def _met(left: DataFrame, right: DataFrame, rows: int, width: int) -> DataFrame:
    """Every two blocks, those of ``right`` (of so many rows) as ``r_`` columns, in parts that a task can hold.

    Of a task's blocks, each one of the left side has its contents beside the first of the right side only, and the other way round.
    """
    parts = max(1, -(-rows * (width * 8 + 32) // (2 * SIDE_BYTES)))
    first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0  # of a task
    a = left.withColumn("first", first)
    b = right.coalesce(parts).select(*[F.col(c).alias(f"r_{c}") for c in right.columns]).withColumn("r_first", first)
    both = a.hint("shuffle_replicate_nl").crossJoin(b)
    return both.select("block", "r_block", *[F.when(F.col("r_first"), F.col(c)).alias(c) for c in left.columns if c != "block"],
                       *[F.when(F.col("first"), F.col(f"r_{c}")).alias(f"r_{c}") for c in right.columns if c != "block"])


def _pairs_of_blocks(batches: Iterator[pa.RecordBatch], kinds: tuple[str, str]) -> Iterator[tuple]:
    """Block, ids and unit vectors of the left side, block, ids, unit vectors and labels of the right one."""
    left, right = (None, None, None), {}
    for batch in batches:
        def numbers(column: str, i: int, kind: str) -> np.ndarray:
            return np.frombuffer(batch.column(column)[i].as_buffer(), kind)

        blocks, others = batch.column("block").to_pylist(), batch.column("r_block").to_pylist()
        for i, (block, other) in enumerate(zip(blocks, others)):
            if batch.column("v")[i].is_valid:
                ids = numbers("ids", i, "int64")
                left = block, ids, unit(numbers("v", i, kinds[0]), len(ids))
            if batch.column("r_v")[i].is_valid:
                labels = batch.column("r_labels")[i].as_py() if "r_labels" in batch.schema.names else []
                right[other] = numbers("r_ids", i, "int64"), numbers("r_v", i, kinds[1]), np.array(labels, dtype=object)
            if left[0] != block:
                raise ValueError("blocks came in another order than a Cartesian product has")
            known, flat, labels = right[other]
            yield *left, other, known, unit(flat, len(known)), labels


def nearest(test: DataFrame, train: DataFrame, k: int, tests: int, trains: int, width: int) -> DataFrame:
    """``id, neighbours`` with the k nearest of the ``train`` rows (id, v, label) for each of the ``test`` rows (id, v)."""
    kinds = _kind(test), _kind(train)
    left = _blocks(test.withColumn("label", F.lit(None).cast("string")), tests, width, "test_blocks").drop("labels")
    right = _blocks(train, trains, width, "train_blocks")

    def answer(block: int, ids: np.ndarray, best: Nearest) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), block)), pa.array(np.arange(len(ids), dtype=np.int32)), pa.array(ids), best.lists()],
                                          names=["block", "place", "id", "neighbours"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, own, best = None, None, None
        for block, ids, rows, _, known, vectors, labels in _pairs_of_blocks(batches, kinds):
            if block != current:
                if best is not None:
                    yield answer(current, own, best)
                current, own, best = block, ids, Nearest(rows, k)
            best.meet(vectors, known, labels)
        if best is not None:
            yield answer(current, own, best)

    met = _met(left, right, trains, width).mapInArrow(search, f"block long, place int, id long, neighbours {NEIGHBOURS}")
    return met.groupBy("block", "place").agg(F.first("id").alias("id"), F.slice(F.sort_array(F.flatten(F.collect_list("neighbours"))), 1, k).alias("neighbours")).drop("block", "place")


def pairs(df: DataFrame, distance: float, rows: int, width: int) -> DataFrame:
    """(id, other, cosine) of all pairs of rows (id, v) at most ``distance`` away, the smaller id first; rows of one id are no pair."""
    kind = _kind(df)
    left = _blocks(df.withColumn("label", F.lit(None).cast("string")), rows, width, "blocks").drop("labels")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, ids, vectors, other, others, other_vectors, _ in _pairs_of_blocks(batches, (kind, kind)):
            # each two blocks meet once, half of them as smaller and larger
            if block != other and (block < other) != ((block + other) % 2 == 0):
                continue
            for row, col, cosine in close(vectors, other_vectors, distance):
                keep = (ids[row] != others[col]) & ((row < col) | (block != other))
                a, b = ids[row[keep]], others[col[keep]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (np.minimum(a, b), np.maximum(a, b), cosine[keep])], names=["id", "other", "cosine"])

    return _met(left, left, rows, width).mapInArrow(search, "id long, other long, cosine double")
