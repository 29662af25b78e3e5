"""Exact k-nearest-neighbour search and votes by cosine distance.

A training table whose counted size fits is broadcast. A larger one is laid out by pivots: unit vectors are points of a
metric space, every training row belongs to the nearest of some pivots, and the rows of a pivot are cut into rings by their
distance to it. Two passes move each training block once: the first one searches the block around every test row, which
bounds its k-th distance, the second one only those blocks that the triangle inequality does not put beyond that bound.
Where a sample of test rows shows that most blocks would stay open, as in many dimensions without near rows, all rows meet
tile by tile instead (:mod:`~flowlake.operators.tiles`).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, drop_scratch
from .tiles import NEIGHBOURS, Nearest, close, nearest, unit

#: Every Python worker holds a broadcast table of its own.
BROADCAST_BYTES = 64 << 20
#: Training rows of a block, on average; blocks of equal distances are cut further by hash.
TRAIN_BLOCK = 20_000
#: Test rows that one task brings to a block; a block asked for by more of them is copied.
TEST_ROWS = 200_000
MOST_PIVOTS = 1024
#: Meetings of a test row and a block, up to which the pivots' use is not judged first, and the test rows that judge it.
FEW_MEETINGS = 200_000
JUDGES = 256
#: Meetings that leave a task in one batch.
_BATCH = 8192
#: Rounding allowance of distances; a block is only left out if it lies beyond the bound by more.
_SLACK = 1e-6


def _matrix(column) -> np.ndarray:
    """Rows of an array column as unit vectors."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return unit(column.flatten().to_numpy(zero_copy_only=False), len(column))


def _neighbour_arrays(test_ids, test, train, train_ids, train_labels, k) -> pa.RecordBatch:
    lists = Nearest(test, k).meet(train, train_ids, train_labels).lists()
    return pa.RecordBatch.from_arrays([test_ids.cast(pa.int64()), lists], names=["id", "neighbours"])


_SCHEMA = f"id long, neighbours {NEIGHBOURS}"


def nearest_neighbours(test: DataFrame, train: DataFrame, k: int = 7, key: str = "vec_id",
                       vector: str = "embedding", label: str = "label",
                       broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``id, neighbours`` with the k nearest training rows of every test row.

    No pair is ever emitted: distances live in one matrix block at a time and
    only the k best per test row leave it. A training table whose counted size
    is above ``broadcast_bytes`` is searched by pivots, or tile by tile if they
    would leave out too little. Of equal distances the smaller id is nearer;
    vectors of length zero are at distance 1 to all.
    """
    queries = test.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"))
    known = train.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"),
                         F.col(label).cast("string").alias("label"))
    rows, width = known.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    if not rows:
        raise ValueError("no training rows")
    if rows * width * 8 <= broadcast_bytes:
        return _broadcast_search(queries, known, k)
    tests = queries.count()
    if pivots_pay(queries, tests, known, rows, k=k):
        return PivotIndex.of(known, rows).search(queries, k)
    return nearest(queries, known, k, tests, rows, width)


def _broadcast_search(queries: DataFrame, known: DataFrame, k: int) -> DataFrame:
    table = known.toArrow()
    shared = queries.sparkSession.sparkContext.broadcast((
        _matrix(table.column("v")), table.column("id").to_numpy(),
        np.array(table.column("label").to_pylist(), dtype=object)))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        train, ids, labels = shared.value
        for batch in batches:
            if batch.num_rows:
                yield _neighbour_arrays(batch.column(0), _matrix(batch.column(1)), train, ids, labels, k)

    return queries.mapInArrow(search, _SCHEMA)


def _lifted(rows: np.ndarray, side: int) -> np.ndarray:
    """Unit vectors with two coordinates more, one for each side, that make vectors of length zero unit vectors too and
    change no inner product between a test row (side 0) and a training row (side 1)."""
    extra = np.zeros((len(rows), 2))
    extra[:, side] = np.sqrt(np.clip(1.0 - (rows ** 2).sum(1), 0.0, 1.0))
    extra[extra < 1e-7] = 0.0  # rounding of the length
    return np.hstack([rows, extra])


def _apart(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Euclidean distances of unit vectors."""
    return np.sqrt(np.maximum(2.0 - 2.0 * rows @ pivots.T, 0.0))


def _own(rows: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pivot of each training row and how far away it is."""
    apart = _apart(_lifted(rows, 1), pivots)
    own = apart.argmin(1)
    return own, apart[np.arange(len(own)), own]


def _count_of_pivots(rows: int) -> int:
    return min(MOST_PIVOTS, max(8, math.isqrt(rows)))


def _first_by_hash(df: DataFrame, rows: int) -> np.ndarray:
    return _matrix(df.orderBy(F.xxhash64("id", "v"), "id").limit(rows).select("v").toArrow().column("v"))


def _pivots(known: DataFrame, rows: int) -> np.ndarray:
    return np.unique(_lifted(_first_by_hash(known, _count_of_pivots(rows)), 1), axis=0)


def pivots_pay(queries: DataFrame, tests: int, known: DataFrame, rows: int, k: int = 1, distance: float | None = None) -> bool:
    """Whether test rows will ask for few blocks by pivots: on average for one each, and one more per training row.

    Asked by ``JUDGES`` test rows, within ``distance`` or else their exact k-th distance, over whole pivots.
    """
    if tests * max(_count_of_pivots(rows), rows // TRAIN_BLOCK) <= FEW_MEETINGS:
        return True
    pivots, judges = _pivots(known, rows), _first_by_hash(queries, JUDGES)
    shared = known.sparkSession.sparkContext.broadcast((pivots, judges))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, judges = shared.value
        near, far, best = np.full(len(pivots), np.inf), np.full(len(pivots), -np.inf), Nearest(judges, k)
        for batch in batches:
            for part in _slices(batch):
                train = _matrix(part.column("v"))
                own, away = _own(train, pivots)
                np.minimum.at(near, own, away)
                np.maximum.at(far, own, away)
                if distance is None:
                    best.meet(train, np.zeros(len(train), np.int64), np.full(len(train), None))
        some = np.flatnonzero(near <= far)
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (np.full(len(some), -1, np.int32), some.astype(np.int32), near[some], far[some])], names=["judge", "pivot", "near", "far"])
        lists = best.lists()
        judge, d = lists.value_parent_indices(), lists.flatten().field("distance")
        yield pa.RecordBatch.from_arrays([judge.cast(pa.int32()), pa.nulls(len(judge), pa.int32()), d, d], names=["judge", "pivot", "near", "far"])

    seen = known.select("v").mapInArrow(look, "judge int, pivot int, near double, far double")
    seen = seen.groupBy("judge", "pivot").agg(F.min("near").alias("near"), F.max("far").alias("far"),
                                              F.sort_array(F.collect_list(F.when(F.col("judge") >= 0, F.col("near")))).alias("all")).collect()
    bound = np.full(len(judges), np.inf if distance is None else distance)
    for r in seen:
        if r.judge >= 0 and len(r.all) >= k:
            bound[r.judge] = r.all[k - 1]
    whole = PivotIndex(None, pivots, np.array([(r.pivot, r.near, r.far) for r in seen if r.judge < 0]))
    asked = whole.least(_lifted(judges, 0)) <= np.sqrt(np.maximum(2 * bound, 0))[:, None] + _SLACK
    return asked.sum(1).mean() * tests <= tests + rows


class PivotIndex:
    """Training rows in blocks: ``rows`` has ``block, id, v, label``, ``blocks`` for each block its pivot and the least and
    largest distance of its rows to it."""

    def __init__(self, rows: DataFrame, pivots: np.ndarray, blocks: np.ndarray):
        self.rows, self.pivots, self.blocks = rows, pivots, blocks

    @classmethod
    def of(cls, known: DataFrame, rows: int, block: int | None = None) -> PivotIndex:
        """Lay out ``known`` (id, v, label); a few numbers per block and at most ``MOST_PIVOTS`` vectors reach the driver."""
        block = block or TRAIN_BLOCK
        pivots = _pivots(known, rows)
        shared = known.sparkSession.sparkContext.broadcast(pivots)

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in _slices(batch):
                    own, away = _own(_matrix(part.column("v")), shared.value)
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(own.astype(np.int32)), pa.array(away)],
                                                     names=[*part.schema.names, "pivot", "away"])

        placed = cut_lineage(known.mapInArrow(place, _fields(known) + ", pivot int, away double"), "placed")
        rings = max(1, -(-rows // (block * len(pivots))))  # of an average pivot
        cuts = placed.groupBy("pivot").agg(F.percentile_approx("away", [(k + 1) / rings for k in range(rings)], 10_000).alias("cuts"))
        ringed = (placed.join(F.broadcast(cuts), "pivot")  # one row per pivot
                  .withColumn("ring", F.size(F.filter("cuts", lambda cut: cut < F.col("away")))).drop("cuts"))
        counts = ringed.groupBy("pivot", "ring").agg(F.ceil(F.count(F.lit(1)) / block).alias("parts"))
        cut = (ringed.join(F.broadcast(counts), ["pivot", "ring"])  # one row per ring
               .withColumn("part", F.pmod(F.xxhash64("id", "v"), F.col("parts"))))
        bounds = cut.groupBy("pivot", "ring", "part").agg(F.min("away").alias("near"), F.max("away").alias("far")).orderBy("pivot", "ring", "part")
        found = bounds.toArrow()
        numbered = found.append_column("block", pa.array(np.arange(found.num_rows)))
        names = known.sparkSession.createDataFrame(numbered.select(["pivot", "ring", "part", "block"]))
        stored = cut_lineage(cut.join(F.broadcast(names), ["pivot", "ring", "part"]).select("block", *known.columns), "blocks")
        drop_scratch(placed)
        return cls(stored, pivots, np.stack([numbered.column(c).to_numpy().astype(float) for c in ("pivot", "near", "far")], 1))

    def least(self, rows: np.ndarray) -> np.ndarray:
        """How near the rows of each block can be at least (test rows x blocks)."""
        to_pivot = _apart(rows, self.pivots)
        pivot, near, far = self.blocks[:, 0].astype(int), self.blocks[:, 1], self.blocks[:, 2]
        ring = np.maximum(to_pivot[:, pivot] - far, near - to_pivot[:, pivot])
        # a row of the block is nearer to its own pivot than to the test row's, so it lies beyond the plane between the two
        own = to_pivot.argmin(1)
        between = _apart(self.pivots[own], self.pivots)
        behind = (to_pivot ** 2 - (to_pivot.min(1) ** 2)[:, None]) / np.maximum(2 * between, 1e-12)
        behind[between < 1e-6] = 0.0
        return np.maximum(ring, behind[:, pivot]).clip(0.0)

    def _shared(self, spark):
        return spark.sparkContext.broadcast((self.pivots, self.blocks))

    def homes(self, queries: DataFrame) -> DataFrame:
        """``queries`` with the one block that lies around each of them."""
        shared = self._shared(queries.sparkSession)

        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = PivotIndex(None, *shared.value)
            for batch in batches:
                for part in _slices(batch):
                    block = index.least(_lifted(_matrix(part.column("v")), 0)).argmin(1)
                    yield part.append_column("block", pa.array(block))

        return queries.mapInArrow(find, _fields(queries) + ", block long")

    def to_meet(self, bounded: DataFrame) -> DataFrame:
        """(id, v, block) for all blocks, but the row's ``block`` if it has one, that may hold a row within ``bound`` of it."""
        shared = self._shared(bounded.sparkSession)

        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = PivotIndex(None, *shared.value)
            for batch in batches:
                for part in _slices(batch):
                    bound = np.sqrt(np.maximum(2 * part.column("bound").to_numpy(), 0))
                    open_to = index.least(_lifted(_matrix(part.column("v")), 0)) <= bound[:, None] + _SLACK
                    if "block" in part.schema.names:
                        open_to[np.arange(part.num_rows), part.column("block").to_numpy()] = False
                    rows, blocks = np.nonzero(open_to)
                    for low in range(0, len(rows), _BATCH):
                        row = pa.array(rows[low:low + _BATCH])
                        yield pa.RecordBatch.from_arrays([part.column("id").take(row), part.column("v").take(row), pa.array(blocks[low:low + _BATCH])],
                                                         names=["id", "v", "block"])

        return bounded.select(*[c for c in bounded.columns if c in ("id", "v", "block", "bound")]).mapInArrow(
            find, f"id long, v {bounded.schema['v'].dataType.simpleString()}, block long")

    def meet(self, asked: DataFrame, k: int) -> DataFrame:
        """The k nearest rows of its block for each row of ``asked`` (id, v, block)."""
        return self._met(asked, lambda ids, test, *train: iter([_neighbour_arrays(ids, test, *train, k)]), _SCHEMA)

    def _met(self, asked: DataFrame, look: Callable[..., Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
        """``look`` (ids and unit vectors of test rows; unit vectors, ids, labels of the block) for all rows of ``asked``."""
        copies = asked.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / TEST_ROWS).cast("int").alias("copies"))
        copies = cut_lineage(copies, "asked")  # one row per block
        wide = "array<float>" if all(df.schema["v"].dataType.simpleString() == "array<float>" for df in (asked, self.rows)) else "array<double>"
        test = (asked.join(F.broadcast(copies), "block").withColumn("copy", F.pmod(F.xxhash64("id"), F.col("copies")).cast("int"))
                .select("block", "copy", F.lit(1).alias("is_test"), "id", F.col("v").cast(wide).alias("v"),
                        F.lit(None).cast("string").alias("label")))
        train = (self.rows.join(F.broadcast(copies), "block")
                 .withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
                 .select("block", "copy", F.lit(0).alias("is_test"), "id", F.col("v").cast(wide).alias("v"), "label"))

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            current, held, ready = None, [], None
            for batch in batches:
                block, copy, is_test = (batch.column(c).to_numpy() for c in ("block", "copy", "is_test"))
                change = np.flatnonzero(np.diff(block) | np.diff(copy) | np.diff(is_test)) + 1
                for low, high in zip([0, *change.tolist()], [*change.tolist(), batch.num_rows]):
                    if high == low:
                        continue
                    key, part = (block[low], copy[low]), batch.slice(low, high - low)
                    if key != current:
                        current, held, ready = key, [], None
                    if not is_test[low]:
                        held.append(part)
                        continue
                    if ready is None:
                        table = pa.Table.from_batches(held)
                        ready = (_matrix(table.column("v")), table.column("id").to_numpy(), np.array(table.column("label").to_pylist(), dtype=object))
                    yield from look(part.column("id"), _matrix(part.column("v")), *ready)

        keys = ["block", "copy"]
        return train.unionByName(test).repartition(*keys).sortWithinPartitions(*keys, "is_test").mapInArrow(search, schema)

    def within(self, queries: DataFrame, distance: float) -> DataFrame:
        """(id, other, cosine) of the test rows and all rows of a larger id at most ``distance`` away (1 - cosine)."""
        def look(ids: pa.Array, test: np.ndarray, train: np.ndarray, train_ids: np.ndarray, labels: np.ndarray) -> Iterator[pa.RecordBatch]:
            own = ids.to_numpy()
            for row, other, cosine in close(test, train, distance):
                keep = own[row] < train_ids[other]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (own[row[keep]], train_ids[other[keep]], cosine[keep])], names=["id", "other", "cosine"])

        asked = cut_lineage(self.to_meet(queries.withColumn("bound", F.lit(float(distance)))), "asked")
        return self._met(asked, look, "id long, other long, cosine double")

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """``id, neighbours`` with the k nearest rows of all blocks."""
        homes = cut_lineage(self.homes(queries), "homes")
        first = cut_lineage(self.meet(homes, k), "first")
        # no k rows at home: every block is open, as no distance exceeds 2
        bound = F.when(F.size("neighbours") == k, F.element_at("neighbours", -1)["distance"]).otherwise(2.0)
        bounded = homes.join(first.select("id", bound.alias("bound")), "id")
        asked = cut_lineage(self.to_meet(bounded), "asked")
        return first.unionByName(self.meet(asked, k)).groupBy("id").agg(
            F.slice(F.sort_array(F.flatten(F.collect_list("neighbours"))), 1, k).alias("neighbours"))


def _fields(df: DataFrame) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields)


def _slices(batch: pa.RecordBatch, rows: int = 512) -> Iterator[pa.RecordBatch]:
    for low in range(0, batch.num_rows, rows):
        yield batch.slice(low, rows)


def predict(neighbours: DataFrame) -> DataFrame:
    """Majority label of the neighbours, the smallest one of a tie."""
    labels = F.transform("neighbours", lambda n: n["label"])
    votes = F.transform(F.array_distinct(labels), lambda name: F.struct(
        (-F.size(F.filter(labels, lambda x: x == name))).alias("order"), name.alias("label")))
    return neighbours.select("id", F.array_min(votes)["label"].alias("predicted"))


def predict_proba(neighbours: DataFrame, classes: list[str]) -> DataFrame:
    """Share of the votes per class, zero shares included."""
    labels = F.transform("neighbours", lambda n: n["label"])
    shares = F.transform(F.lit(classes), lambda name: F.struct(
        name.alias("class"),
        (F.size(F.filter(labels, lambda x: x == name)) / F.size(labels)).alias("probability")))
    return neighbours.select("id", F.inline(shares))
