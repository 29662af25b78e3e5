"""Benchmark decontamination: normalised n-gram windows of test items searched in training texts.

Words are runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after A-Z became lower case. A window is ``width``
consecutive words of an item; an item with fewer words, but not none, is one window. A document word is hit if
it lies inside any occurrence of a window.

The windows' hashes are a set that is broadcast. Its size is bounded: items are dealt to blocks of at most
about ``BLOCK_BYTES`` of item text by hash, and every block makes a pass of its own over the documents, which
adds to the spans of the pass before; so a larger benchmark costs more passes and no more memory. Each hash that a document window meets is verified
against the item's words before it counts.

Edge cases: null texts and texts without words have no hits; null items and items without words have no
windows; repeated items count under each of their ids (null ids are not listed); rows that repeat a doc_id are
rows of their own; an empty benchmark leaves everything clean.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlake.llm import kernels as K
from flowlake.llm.routing import numbered
from flowlake.session import cut_lineage

WIDTH = 10
#: Item text per broadcast set; a set takes about a hundred times as much memory in a task.
BLOCK_BYTES = 4 << 20
_LETTERS = bytes(c if c in range(0x30, 0x3A) or c in range(0x61, 0x7B) or c >= 0x80 else c + 32 if c in range(0x41, 0x5B) else 0x20
                 for c in range(256))


def plain_words(text: bytes) -> list[bytes]:
    """The words of a UTF-8 text, lower-cased."""
    return text.translate(_LETTERS).split()


class WindowSet:
    """The windows of some items: exact lookup by words, quick lookup by hash for each width that occurs."""

    def __init__(self, items: list[tuple[int | None, bytes | None]], width: int = WIDTH):
        self.items: dict[tuple[bytes, ...], set] = defaultdict(set)
        for item, text in items:
            found = plain_words(text or b"")
            for at in range(max(1, len(found) - width + 1) if found else 0):
                window = tuple(found[at: at + width])
                self.items[window].update(() if item is None else (item,))
        by_width: dict[int, list] = defaultdict(list)
        for window in self.items:
            by_width[len(window)].append(window)
        self.hashes = {}
        for size, known in by_width.items():
            text = b" ".join(b" ".join(w) for w in known)
            found = K.words(np.frombuffer(text, np.uint8), np.array([0, len(text)]), K.ALNUM_OR_HIGH)
            values = np.unique(K.windows(found.hash, size)[::size])
            quick = np.zeros(1 << 18, bool)
            quick[values & np.uint64((1 << 18) - 1)] = True
            self.hashes[size] = (quick, values)

    def search(self, data: np.ndarray, found: K.Words) -> list[tuple[int, int, int, tuple]]:
        """(row, first word, words, window) of every verified occurrence; word numbers are those of ``found``."""
        hits = []
        for size, (quick, values) in self.hashes.items():
            seen = K.windows(found.hash, size)
            at = np.flatnonzero(quick[seen & np.uint64((1 << 18) - 1)])
            at = at[found.row[at] == found.row[at + size - 1]]
            place = np.minimum(np.searchsorted(values, seen[at]), len(values) - 1)
            for first in at[values[place] == seen[at]].tolist():
                window = tuple(plain_words(data[found.start[first]: found.end[first + size - 1]].tobytes()))
                if window in self.items:
                    hits.append((int(found.row[first]), first, size, window))
        return hits


_SPAN = pa.struct([("first", pa.int64()), ("last", pa.int64()), ("start", pa.int64()), ("stop", pa.int64())])
_ADDED = {"_n_words": "long", "_spans": "array<struct<first:long,last:long,start:long,stop:long>>", "_items": "array<string>"}


def united(spans: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Spans (first word, word after, first byte, byte after) in order, united where they overlap."""
    out: list[list[int]] = []
    for first, last, start, stop in sorted(spans):
        if out and first < out[-1][1]:
            out[-1][1], out[-1][3] = max(out[-1][1], last), max(out[-1][3], stop)
        else:
            out.append([first, last, start, stop])
    return [tuple(x) for x in out]


def _scan(windows, text_col: str, again: bool):
    """Adds word counts, hit spans and item ids to batches, to those of an earlier pass if there are any."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: WindowSet = windows.value
        for batch in batches:
            n = batch.num_rows
            counts, spans, items = np.zeros(n, np.int64), [[] for _ in range(n)], [set() for _ in range(n)]
            for low, high, data, offsets in K.text_slices(batch.column(batch.schema.get_field_index(text_col))):
                found = K.words(data, offsets, K.ALNUM_OR_HIGH)
                counts[low:high] = np.bincount(found.row, minlength=high - low)
                begins = np.searchsorted(found.row, np.arange(high - low))
                for row, first, size, window in known.search(data, found):
                    at, text_at = int(begins[row]), int(offsets[row])
                    spans[low + row].append((first - at, first - at + size, int(found.start[first]) - text_at,
                                             int(found.end[first + size - 1]) - text_at))
                    items[low + row].update(map(str, known.items[window]))
            columns = {n: c for n, c in zip(batch.schema.names, batch.columns) if n not in _ADDED}
            if again:
                for row, (old, names) in enumerate(zip(batch.column("_spans").to_pylist(), batch.column("_items").to_pylist())):
                    spans[row] += [tuple(x.values()) for x in old]
                    items[row].update(names)
            columns["_n_words"] = pa.array(counts)
            columns["_spans"] = pa.array([[dict(zip(("first", "last", "start", "stop"), x)) for x in united(s)] if s else []
                                          for s in spans], pa.list_(_SPAN))
            columns["_items"] = pa.array([sorted(x) for x in items], pa.list_(pa.string()))
            yield pa.RecordBatch.from_pydict(columns)
    return run


def _blocks(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[list]:
    """The different items in blocks of bounded size (a larger item is a block of its own); the driver holds one at a time."""
    sized = benchmark.select(F.col(item_col).alias("item"), F.col(text_col).cast("binary").alias("text")).filter("length(text) > 0").distinct()
    total = sized.agg(F.sum(F.length("text"))).first()[0] or 0
    if total <= BLOCK_BYTES:
        yield sized.collect()
        return
    buckets = int(16 * -(-total // BLOCK_BYTES))
    bucket = F.pmod(F.xxhash64("text", "item"), F.lit(buckets))
    held, first = 0, 0
    for number, size in sized.groupBy(bucket.alias("bucket")).agg(F.sum(F.length("text"))).orderBy("bucket").toLocalIterator():
        if held and held + size > BLOCK_BYTES:
            yield sized.filter(bucket.between(first, number - 1)).collect()
            held, first = 0, number
        held += size
    yield sized.filter(bucket >= first).collect()


def hit_spans(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
              item_text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """``docs`` with ``_n_words``, ``_spans`` (word and byte ranges that are hit) and ``_items`` (ids as sorted strings),
    which take the place of columns of these names."""
    spark, found = docs.sparkSession, docs
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name not in _ADDED)
    fields += "".join(f", {name} {kind}" for name, kind in _ADDED.items())
    for done, items in enumerate(_blocks(benchmark, item_col, item_text_col)):
        if done:
            found = cut_lineage(found, "spans")
        known = spark.sparkContext.broadcast(WindowSet([(r.item, bytes(r.text)) for r in items], width))
        found = found.mapInArrow(K.releasing(_scan(known, text_col, done > 0)), fields)
    return found


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Per document: id, n_words, n_hit, n_items, items (sorted ids), spans, contaminated."""
    found = hit_spans(docs.select(id_col, text_col), benchmark, text_col, **options)
    hit = F.aggregate("_spans", F.lit(0).cast("long"), lambda total, s: total + s["last"] - s["first"])
    return found.select(id_col, F.col("_n_words").alias("n_words"), hit.alias("n_hit"), F.size("_items").cast("long").alias("n_items"),
                        F.col("_items").alias("items"), F.col("_spans").alias("spans"), (F.size("_spans") > 0).alias("contaminated"))


def clean_documents(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The documents without any hit, with the columns of ``docs``."""
    plain, name = numbered(docs)
    return hit_spans(plain, benchmark, name[text_col], **options).filter(F.size("_spans") == 0).select(plain.columns).toDF(*docs.columns)


def without_spans(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """All documents, with the bytes of hit spans cut out of their texts."""
    plain, name = numbered(docs)
    text = name[text_col]
    raw = F.col(text).cast("binary")
    start = F.aggregate(  # (kept so far, next byte to keep)
        "_spans", F.struct(F.lit(b"").alias("kept"), F.lit(0).cast("long").alias("at")),
        lambda a, s: F.struct(F.concat(a["kept"], raw.substr(a["at"].cast("int") + 1, (s["start"] - a["at"]).cast("int"))).alias("kept"), s["stop"].alias("at")))
    left = F.concat(F.col("_left.kept"), raw.substr(F.col("_left.at").cast("int") + 1, F.length(raw)))
    found = hit_spans(plain, benchmark, text, **options).withColumn("_left", start)
    cut = F.when(F.size("_spans") == 0, F.col(text)).otherwise(left.cast("string"))
    return found.withColumn(text, cut).select(plain.columns).toDF(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    found = contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", "n_items",
                        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS win
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM bw),
dw AS (SELECT doc_id, i, size, array_to_string(w[i:i + size - 1], ' ') AS win
       FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes WHERE len(w) >= size)),
hits AS (SELECT doc_id, i, dw.size, item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.size = bw.size),
places AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM hits) GROUP BY doc_id),
names AS (SELECT doc_id, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS items
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS name FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN places USING (doc_id) LEFT JOIN names USING (doc_id)
"""
