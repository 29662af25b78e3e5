"""Exact deduplication by counting quotient filters.

Texts are equal when they are identical after every run of ``[\\x20\\x09-\\x0D]`` became one space; null
counts as empty. Each partition packs the fingerprints of its texts into a counting quotient filter. The
filters are cut into slices by quotient and merged slice by slice, in order of their remainders, which loses
no fingerprint and no count. A text whose fingerprint has count one is unique. The others, and only they, go
on to byte verification, which groups them by their whole text; equal texts meet in a map-side aggregate
first, so a group that holds a third of all rows sends one row per task.

Edge cases: empty texts are one group; rows that repeat a doc_id with an equal text are copies of each other
and all carry ``kept``; a null doc_id never is ``keep_id`` unless its group has no other; an empty table gives
an empty result; further columns are left aside.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlake.llm.routing import numbered, routed
from flowlake.session import cut_lineage, drop_scratch

#: Fingerprints are 64 bits: the leading bits are the quotient, the rest the remainder.
QUOTIENT_BITS = 24
#: Most fingerprints that a slice of the merged filter holds on average.
SLICE_FINGERPRINTS = 500_000


class CountingQuotientFilter:
    """A static counting quotient filter.

    ``quotients`` has the occupied quotients in order and ``runs`` the length of each one's run;
    ``remainders`` has the runs one after the other, sorted within a run, and ``counts`` how often each
    fingerprint was added.
    """

    def __init__(self, quotients: np.ndarray, runs: np.ndarray, remainders: np.ndarray, counts: np.ndarray):
        self.quotients, self.runs, self.remainders, self.counts = quotients, runs, remainders, counts

    @classmethod
    def of(cls, fingerprints: np.ndarray, counts: np.ndarray | None = None) -> CountingQuotientFilter:
        """From unsigned 64-bit fingerprints in any order, each with a count (1 if not given)."""
        order = np.argsort(fingerprints, kind="stable")
        ordered = fingerprints[order]
        first = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]]) if len(ordered) else np.zeros(0, np.int64)
        added = np.ones(len(ordered), np.int64) if counts is None else counts[order]
        distinct = ordered[first]
        quotient = (distinct >> np.uint64(64 - QUOTIENT_BITS)).astype(np.int64)
        occupied, runs = np.unique(quotient, return_counts=True)
        remainder = distinct & np.uint64((1 << (64 - QUOTIENT_BITS)) - 1)
        return cls(occupied, runs, remainder, np.add.reduceat(added, first) if len(first) else added)

    @classmethod
    def merged(cls, filters: list[CountingQuotientFilter]) -> CountingQuotientFilter:
        """The filter of all additions; fingerprints that several filters hold add their counts."""
        return cls.of(np.concatenate([f.fingerprints() for f in filters]), np.concatenate([f.counts for f in filters]))

    def fingerprints(self) -> np.ndarray:
        """The fingerprints, sorted: quotient and remainder put together again."""
        high = np.repeat(self.quotients.astype(np.uint64), self.runs) << np.uint64(64 - QUOTIENT_BITS)
        return high | self.remainders

    def slices(self, bits: int) -> Iterator[tuple[int, CountingQuotientFilter]]:
        """The parts that share the leading ``bits`` of the quotient."""
        part = self.quotients >> (QUOTIENT_BITS - bits)
        cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else []
        places = np.r_[0, np.cumsum(self.runs)]
        for low, high in zip(cuts, [*cuts[1:], len(part)]):
            a, b = places[low], places[high]
            yield int(part[low]), CountingQuotientFilter(
                self.quotients[low:high], self.runs[low:high], self.remainders[a:b], self.counts[a:b])

    def pack(self) -> tuple[bytes, bytes, bytes, bytes]:
        """Quotients, run lengths, remainders (5 bytes each) and counts as bytes."""
        narrow = np.ascontiguousarray(self.remainders.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :5]
        return (self.quotients.astype("<i4").tobytes(), self.runs.astype("<i4").tobytes(), narrow.tobytes(),
                self.counts.astype("<i8").tobytes())

    @classmethod
    def unpack(cls, quotients: bytes, runs: bytes, remainders: bytes, counts: bytes) -> CountingQuotientFilter:
        narrow = np.frombuffer(remainders, np.uint8).reshape(-1, 5)
        wide = np.zeros((len(narrow), 8), np.uint8)
        wide[:, :5] = narrow
        return cls(np.frombuffer(quotients, "<i4").astype(np.int64), np.frombuffer(runs, "<i4").astype(np.int64),
                   wide.view("<u8").reshape(-1), np.frombuffer(counts, "<i8"))


def normalised(text: Column) -> Column:
    """``text`` with every run of white space as one space; null as the empty text.

    The pattern leaves single spaces alone, which are most runs, and so replaces little.
    """
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " ")


def _partition_filters(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b.column(0).to_numpy(zero_copy_only=False).astype(np.int64) for b in batches]
        own = CountingQuotientFilter.of(np.concatenate(parts or [np.zeros(0, np.int64)]).view(np.uint64))
        for part, piece in own.slices(bits):
            yield pa.RecordBatch.from_pydict({"slice": pa.array([part], pa.int32())} | {
                name: pa.array([value], pa.binary()) for name, value in zip(_PACKED, piece.pack())})
    return run


_PACKED = ("quotients", "runs", "remainders", "counts")


def _repeated_of_slice(table: pa.Table) -> pa.Table:
    merged = CountingQuotientFilter.merged([
        CountingQuotientFilter.unpack(*row) for row in zip(*(table.column(n).to_pylist() for n in _PACKED))])
    often = merged.counts > 1
    return pa.table({"fingerprint": merged.fingerprints()[often].view(np.int64), "copies": merged.counts[often]})


def repeated_fingerprints(fingerprints: DataFrame, column: str, rows: int) -> DataFrame:
    """(fingerprint, copies) of the fingerprints that occur more than once among ``rows`` rows."""
    bits = min(QUOTIENT_BITS, max(4, (max(rows, 1) // SLICE_FINGERPRINTS).bit_length() + 1))
    slices = fingerprints.select(column).mapInArrow(
        _partition_filters(bits), "slice int, quotients binary, runs binary, remainders binary, counts binary")
    return slices.groupBy("slice").applyInArrow(_repeated_of_slice, "fingerprint long, copies long")


def _prepare(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Id, fingerprint and digest of every text, and the repeated fingerprints; both written."""
    text = normalised(F.col(text_col))
    prints = cut_lineage(docs.select(F.col(id_col).alias("doc_id"), text.alias("_text")).select(
        "doc_id", F.xxhash64("_text").alias("_fp"), F.sha2(F.col("_text").cast("binary"), 256).alias("text_sha256")), "prints")
    return prints, cut_lineage(repeated_fingerprints(prints, "_fp", prints.count()), "repeated")


def _groups(docs: DataFrame, repeated: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Byte verification: the groups of two and more equal texts among the rows that the map lets through."""
    texts = docs.select(F.col(id_col).alias("doc_id"), normalised(F.col(text_col)).alias("_text")).withColumn("_fp", F.xxhash64("_text"))
    return (routed(texts, "_fp", repeated, "fingerprint").filter("_routed").groupBy("_fp", "_text")
            .agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
            .filter("group_size > 1")
            .select("_fp", F.sha2(F.col("_text").cast("binary"), 256).alias("text_sha256"), "keep_id", "group_size"))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256 (of the normalised text)."""
    prints, repeated = _prepare(docs, id_col, text_col)
    found = prints.join(_groups(docs, repeated, id_col, text_col), ["_fp", "text_sha256"], "left")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return found.select(
        "doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256")


def distinct_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: of equal texts the one with the smallest id, and one of repeated rows.

    Rows that the map of repeated fingerprints does not let through stay where they are; only the others
    are shuffled.
    """
    plain, name = numbered(docs)
    own_id, text = name[id_col], normalised(F.col(name[text_col]))
    prints, repeated = _prepare(docs, id_col, text_col)
    drop_scratch(prints)
    groups = _groups(docs, repeated, id_col, text_col).select(
        "_fp", F.col("text_sha256").alias("_sha"), "keep_id", F.lit(True).alias("_grouped"))
    marked = routed(plain.withColumn("_text", text).withColumn("_fp", F.xxhash64("_text")), "_fp", repeated, "fingerprint")
    possible = marked.filter("_routed").withColumn("_sha", F.sha2(F.col("_text").cast("binary"), 256)).join(groups, ["_fp", "_sha"], "left")
    single = possible.filter("_grouped IS NULL")
    first = possible.filter(F.col("_grouped") & F.col(own_id).eqNullSafe(F.col("keep_id"))).dropDuplicates(["_fp", "_sha"])
    parts = [part.select(plain.columns) for part in (marked.filter("NOT _routed"), single, first)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).toDF(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    return exact_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept,
       sha256(norm) AS text_sha256
FROM t WINDOW w AS (PARTITION BY norm)
"""
