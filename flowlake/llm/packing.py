"""Packed token-id rows of one length, by best-fit-decreasing with a segment tree.

Every text becomes its token ids and the end id. A text longer than a row is cut into pieces that fill rows, in
order, and a rest, so nothing is lost. Each task packs the texts it reads: pieces go, longest first, to the row
with the least room that still takes them, which a segment tree over the room left finds in logarithmic time.
A task holds about ``BUFFER_IDS`` ids at a time; rows that are not nearly full are opened again for the next
buffer. No ids are shuffled.

A packed row has its ids, padded to the row's length, the cumulative lengths of its segments (one more than
segments), the position ids, which restart at 0 with every segment, and for each segment its document, piece
number and first id within the document.

Edge cases: null and empty texts are one segment of the end id; a null doc_id stays null; rows that repeat a
doc_id are documents of their own; ties in length keep the order of reading; an empty table gives no rows;
further columns are left aside.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlake.llm import kernels as K

ROW_IDS = 2048
BUFFER_IDS = 4 << 20
#: Rows with at least this share of their ids taken are not opened again.
_FULL = 0.98


class RoomTree:
    """Open rows by the room they have left; ``take`` finds the least room that is enough.

    A node says how many rows lie below it; leaf c stands for rows with room c.
    """

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(self.leaves)]

    def put(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        self._add(room, 1)

    def _add(self, room: int, change: int) -> None:
        node = room + self.leaves
        while node:
            self.count[node] += change
            node >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """(room, row) of the row with the least room of at least ``least``; the row is taken out."""
        node = least + self.leaves
        if not self.count[node]:
            while node > 1 and (node & 1 or not self.count[node + 1]):  # up until a right neighbour has rows
                node >>= 1
            if node == 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if self.count[2 * node] else 2 * node + 1
        room = node - self.leaves
        row = self.rows[room].pop()
        self._add(room, -1)
        return room, row


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """The indexes of ``lengths`` (each at most ``capacity``) per row, in the order they were placed."""
    tree = RoomTree(capacity)
    rows: list[list[int]] = []
    for k in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        found = tree.take(lengths[k])
        room, row = found or (capacity, len(rows))
        if found is None:
            rows.append([])
        rows[row].append(k)
        if room > lengths[k]:
            tree.put(room - lengths[k], row)
    return rows


class Piece(NamedTuple):
    doc: int | None
    part: int
    first: int
    ids: np.ndarray


def pieces(doc: int | None, ids: np.ndarray, capacity: int) -> Iterator[Piece]:
    """A document's pieces: full rows, then the rest."""
    for part, first in enumerate(range(0, len(ids), capacity)):
        yield Piece(doc, part, first, ids[first: first + capacity])


_FIELDS = ("shard int, row int, n_ids int, ids binary, positions binary, cu_seqlens array<int>, "
           "doc_ids array<long>, parts array<int>, firsts array<long>")


def _written(shard: int, number: int, rows: list[list[Piece]], capacity: int, pad: int) -> pa.RecordBatch:
    ids = np.full((len(rows), capacity), pad, "<i4")
    positions = np.zeros((len(rows), capacity), "<i4")
    bounds = []
    for at, row in enumerate(rows):
        ends = np.cumsum([0, *(len(p.ids) for p in row)]).tolist()
        for piece, low, high in zip(row, ends, ends[1:]):
            ids[at, low:high] = piece.ids
            positions[at, low:high] = np.arange(high - low)
        bounds.append(ends)
    return pa.RecordBatch.from_pydict({
        "shard": pa.array([shard] * len(rows), pa.int32()), "row": pa.array(range(number, number + len(rows)), pa.int32()),
        "n_ids": pa.array([b[-1] for b in bounds], pa.int32()), "ids": pa.array([x.tobytes() for x in ids], pa.binary()),
        "positions": pa.array([x.tobytes() for x in positions], pa.binary()), "cu_seqlens": pa.array(bounds, pa.list_(pa.int32())),
        "doc_ids": pa.array([[p.doc for p in r] for r in rows], pa.list_(pa.int64())),
        "parts": pa.array([[p.part for p in r] for r in rows], pa.list_(pa.int32())),
        "firsts": pa.array([[p.first for p in r] for r in rows], pa.list_(pa.int64()))})


def _pack(make_encoder: Callable, end_id: int, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = make_encoder()
        shard, number, held, waiting = K.partition(), 0, 0, []

        def pack(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal number, held, waiting
            rows = [[waiting[k] for k in row] for row in best_fit_decreasing([len(p.ids) for p in waiting], capacity)]
            done, waiting, held = [], [], 0
            for row in sorted(rows, key=lambda r: sum(len(p.ids) for p in r)):  # the emptiest wait for more, half a buffer at most
                size = sum(len(p.ids) for p in row)
                if last or size >= _FULL * capacity or held + size > BUFFER_IDS // 2:
                    done.append(row)
                else:
                    waiting += row
                    held += size
            for a in range(0, len(done), 256):
                yield _written(shard, number, done[a:a + 256], capacity, end_id)
                number += len(done[a:a + 256])

        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    ids = np.asarray([*encode(text or ""), end_id], "<i4")
                    waiting += pieces(doc, ids, capacity)
                    held += len(ids)
                    if held >= BUFFER_IDS:
                        yield from pack(False)
        if waiting:
            yield from pack(True)
    return run


def packed_rows(docs: DataFrame, make_encoder: Callable, end_id: int, capacity: int = ROW_IDS, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """Packed rows of ``docs``. ``make_encoder`` is called in each task and gives a function from text to ids.

    ids and positions are little-endian 32-bit rows of ``capacity``; (shard, row) names a row.
    """
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        _pack(make_encoder, end_id, capacity), _FIELDS)


def write_matrices(rows: DataFrame, path: str) -> None:
    """Write packed rows as a table: each file is a matrix of fixed-length id rows with its positions and bounds."""
    rows.write.parquet(path)


def unpacked(rows: DataFrame) -> DataFrame:
    """(doc_id, ids) of the documents again, ids with the end id as binary; the inverse of packing.

    Only for doc_ids that are unique.
    """
    length = F.transform(F.sequence(F.lit(1), F.size("cu_seqlens") - 1), lambda k: F.element_at("cu_seqlens", k + 1) - F.element_at("cu_seqlens", k))
    each = rows.select(F.explode(F.arrays_zip("doc_ids", "parts", F.slice("cu_seqlens", F.lit(1), F.size("doc_ids")).alias("at"), length.alias("n"))).alias("s"), "ids")
    piece = each.select(F.col("s.doc_ids").alias("doc_id"), F.col("s.parts").alias("part"),
                        F.col("ids").substr(F.col("s.at") * 4 + 1, F.col("s.n") * 4).alias("ids"))
    joined = F.array_sort(F.collect_list(F.struct("part", "ids")))  # the pieces of one document
    return piece.groupBy("doc_id").agg(joined.alias("p")).select("doc_id", F.concat(F.lit(b""), F.expr("aggregate(p.ids, X'', (a, x) -> concat(a, x))")).alias("ids"))


_encoders: dict = K.Cache()


def public_encoder():
    """Encoder of the public 50k vocabulary, made once per worker."""
    if "public" not in _encoders:
        import base64

        import public_tokenizers
        import tiktoken
        with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _encoders["public"] = tiktoken.Encoding("public", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders["public"].encode_ordinary


#: The free id of the public vocabulary.
END_ID = 50256


def query(spark, sf_dir: str) -> DataFrame:
    rows = packed_rows(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_encoder, END_ID)
    return rows.select("shard", "row", "n_ids", "cu_seqlens", "doc_ids", "parts", "firsts", F.sha2("ids", 256).alias("ids_sha256"),
                       F.sha2("positions", 256).alias("positions_sha256"))
