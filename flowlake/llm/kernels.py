"""Vectorised word kernels over Arrow text columns, shared by the operators of this package.

A kernel works on slices of a few megabytes of one Arrow batch, so its memory
does not depend on the partition. Words carry 64-bit hashes; two different words
of a table share one with a chance of about (distinct words)^2 / 2^65.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext

SLICE_BYTES = 2 << 20
_MULTIPLIER = 0x9E3779B97F4A7C15 | 5
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)
_BYTE_VALUES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)


class Cache(dict):
    """What a process works out once. Task functions travel by value with the globals that they use; a cache that the
    driver has filled would go along with each of them, so it travels empty."""

    def __reduce__(self):
        return Cache, ()


_powers: dict[str, np.ndarray] = Cache()


def releasing(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], *caches: Cache):
    """``run``, which empties these caches and those of this module at its end.

    As functions travel by value, each task fills caches of its own. They hang on globals that refer to themselves, so
    without this they would stay in the worker until Python looks for cycles, beside those of the tasks that follow.
    """
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            for cache in (_powers, *caches):
                cache.clear()
    return task


#: Byte tables: what belongs to a word, and A-Z lower-cased.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
NOT_SPACE = ~SPACE
ALNUM_OR_HIGH = np.zeros(256, bool)
ALNUM_OR_HIGH[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


class Words(NamedTuple):
    """Words of a slice in text order: row within the slice, byte bounds within its data, hash."""
    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray


def mix(values: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    values = values ^ (values >> np.uint64(30))
    values = values * np.uint64(0xBF58476D1CE4E5B9)
    values = values ^ (values >> np.uint64(27))
    values = values * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def powers(kind: str, count: int) -> np.ndarray:
    """The first powers of the hash multiplier ("up") or of its inverse ("down"), modulo 2^64."""
    have = _powers.get(kind)
    if have is None or len(have) < count:
        size = max(count, SLICE_BYTES + 1)
        base = np.full(size, _MULTIPLIER if kind == "up" else _INVERSE, np.uint64)
        base[0] = 1
        _powers[kind] = have = np.cumprod(base, dtype=np.uint64)
    return have[:count]


def text_slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) for runs of rows of about ``most`` bytes; null counts as empty.

    A single longer text is a slice of its own.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    if not len(column):
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset: column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        end = max(int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1, first + 1)
        end = min(end, len(column))
        yield first, end, raw[offsets[first]: offsets[end]], offsets[first: end + 1] - offsets[first]
        first = end


def words(data: np.ndarray, offsets: np.ndarray, belongs: np.ndarray, fold: np.ndarray = LOWER) -> Words:
    """Maximal runs of bytes that ``belongs`` marks, within rows, hashed after ``fold``."""
    size = len(data)
    inside = np.zeros(size + 1, bool)
    inside[:size] = belongs[data]
    before = np.zeros(size + 1, bool)
    before[1:] = inside[:-1]
    before[offsets] = False
    after = np.zeros(size + 1, bool)
    after[:-1] = inside[1:]
    after[offsets[offsets > 0] - 1] = False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    total = np.zeros(size + 1, np.uint64)
    np.cumsum(_BYTE_VALUES[fold[data]] * powers("up", size), out=total[1:], dtype=np.uint64)
    value = (total[end] - total[start]) * powers("down", size + 1)[start]
    row = np.searchsorted(offsets, start, "right") - 1
    return Words(row, start, end, mix(value + (end - start).astype(np.uint64)))


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` neighbouring word hashes; shorter by width - 1."""
    count = len(hashes) - width + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    value = np.full(count, width, np.uint64)
    for k in range(width):
        value = value * np.uint64(_MULTIPLIER) + hashes[k: k + count]
    return mix(value)


def partition() -> int:
    """Number of the running task's partition; 0 outside of a task."""
    task = TaskContext.get()
    return task.partitionId() if task else 0


def signed(values: np.ndarray) -> pa.Array:
    """64-bit hashes as Spark longs."""
    return pa.array(np.ascontiguousarray(values).view(np.int64))


def binary_rows(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The byte runs [start, end) of ``data`` as a binary array."""
    length = (end - start).astype(np.int64)
    offsets = np.zeros(len(start) + 1, np.int32)
    np.cumsum(length, out=offsets[1:])
    index = np.arange(offsets[-1], dtype=np.int64) + np.repeat(start - offsets[:-1], length)
    return pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(data[index])])


def streamed_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The runs of equal keys of sorted batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        cut = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in columns])) + 1
        edges = [0, *cut.tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            key = tuple(c[a] for c in columns)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)
