"""Quality scores by compression with dictionaries of good and of bad text.

Two zstandard dictionaries are trained on equally many segments of texts labelled 1 and of texts labelled 0. A text
is cut into segments of ``SEGMENT`` bytes and every segment is compressed with both. What the bad dictionary needs
beyond the good one, divided by the text's length, is the difference of the two normalised compressed sizes. It is
drawn to the mean of the labelled rows as if by ``DAMPING`` bytes more, so that a text of a few words, of which the
sizes say little, is judged as the average one. A logistic curve, fitted on labelled rows that no dictionary saw,
turns it into the probability of label 1.

The fit reads a bounded sample, ``FIT_ROWS`` labelled rows of each label and use and ``FIT_SEGMENTS`` segments of each
label, those with the smallest hashes; only ids and segments of it ever reach the driver. Every text is scored whole
in its own task, segment by segment, so memory depends neither on the text nor on the partition.

Edge cases: a null text counts as empty; an empty text has the mean difference and its score; rows
without a label, or with another one than 0 and 1, are not learned from; an id with several labels is learned from
once for each; a label without any text has no dictionary; without calibration rows the score is one half for all; an
empty table gives an empty result; columns named as those added are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlake.llm.language_id import remainder

SEGMENT = 1024
#: The bound of the sample: rows of each label for the dictionaries and as many for the curve.
FIT_ROWS = 20_000
#: Most segments of each label that a dictionary is trained on.
FIT_SEGMENTS = 4_000
#: Bytes of a dictionary, the library's own default.
DICTIONARY_BYTES = 112_640
LEVEL = 3
#: Bytes of average text that count beside the text's own.
DAMPING = 64
#: Differences are counted in steps of this size for the curve.
_STEP = 1 / 2000
_ADDED = ("_saved", "_length", "_difference", "_score")


class QualityModel(NamedTuple):
    """Dictionaries of the good and the bad text (empty: none), mean difference, the curve's slope and intercept."""
    good: bytes
    bad: bytes
    mean: float = 0.0
    slope: float = 0.0
    intercept: float = 0.0

    def difference(self, saved: np.ndarray, length: np.ndarray) -> np.ndarray:
        return (saved + DAMPING * self.mean) / (length + DAMPING)

    def score(self, difference: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * difference + self.intercept, -500, 500)))


def dictionary(segments: list[bytes]) -> bytes:
    """A trained dictionary, or the segments themselves where there are too few to train one."""
    if not segments:
        return b""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, segments, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(segments)[-DICTIONARY_BYTES:]


class Sizer:
    """Compressed sizes under one dictionary."""

    def __init__(self, content: bytes):
        known = None
        if content:
            known = zstandard.ZstdCompressionDict(content)
            known.precompute_compress(level=LEVEL)
        self._compress = zstandard.ZstdCompressor(
            level=LEVEL, dict_data=known, write_content_size=False, write_checksum=False, write_dict_id=False).compress

    def size(self, segment: bytes) -> int:
        return len(self._compress(segment))


def segments_of(text: bytes) -> Iterator[bytes]:
    for at in range(0, len(text), SEGMENT):
        yield text[at:at + SEGMENT]


def bytes_saved(text: bytes, good: Sizer, bad: Sizer) -> int:
    """By how much the text is smaller under the good dictionary than under the bad one."""
    return sum(bad.size(s) - good.size(s) for s in segments_of(text))


def curve(values: np.ndarray, labels: np.ndarray, counts: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of the logistic curve through counted values, by Newton steps.

    The targets are those of Platt's method, a little inside 0 and 1, so that values that separate the labels
    wholly have a finite slope as well.
    """
    positive, total = float(counts[labels == 1].sum()), float(counts.sum())
    if not total:
        return 0.0, 0.0
    target = np.where(labels == 1, (positive + 1) / (positive + 2), 1 / (total - positive + 2))
    design = np.stack([values, np.ones(len(values))], 1)
    ridge = np.diag([1e-6, 1e-9])  # values that are all equal leave the slope open

    def loss(at: np.ndarray) -> float:
        logit = design @ at
        return float((counts * (np.logaddexp(0, logit) - target * logit)).sum() + at @ ridge @ at / 2)

    found = np.array([0.0, np.log((positive + 1) / (total - positive + 1))])
    for _ in range(100):
        share = 1 / (1 + np.exp(-np.clip(design @ found, -500, 500)))
        slope = design.T @ (counts * (share - target)) + ridge @ found
        bend = (design * (counts * share * (1 - share))[:, None]).T @ design + ridge + 1e-12 * np.eye(2)
        step, length = np.linalg.solve(bend, slope), 1.0
        while length > 1e-6 and loss(found - length * step) > loss(found):
            length /= 2
        found = found - length * step
        if np.abs(length * step).max() < 1e-9 * (1 + np.abs(found).max()):
            break
    return float(found[0]), float(found[1])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for label, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            pieces = list(segments_of(text.as_py() or b""))
            yield pa.RecordBatch.from_pydict({"label": pa.array([label] * len(pieces), pa.int32()), "segment": pa.array(pieces, pa.binary())})


def _sample(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """(label, text) of up to ``rows`` labelled rows of each label; ``docs`` is (id, text), ``labels`` (id, label)."""
    def of(label: int) -> DataFrame:
        return labels.filter(F.col("label") == label).orderBy(F.xxhash64("id"), "id").limit(rows)

    chosen = of(0).unionByName(of(1))  # at most twice ``rows`` ids, which bounds the broadcast
    return docs.join(F.broadcast(chosen), "id").select(F.col("label").cast("int").alias("label"), F.col("text").cast("binary").alias("text"))


def fit(docs: DataFrame, dictionary_labels: DataFrame, curve_labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "quality", rows: int = FIT_ROWS) -> QualityModel:
    """Train the dictionaries on the rows of one label table (id, label) and the curve on those of the other."""
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    known, held = (t.select(F.col(id_col).alias("id"), F.col(label_col).alias("label")) for t in (dictionary_labels, curve_labels))
    cut = _sample(texts, known, rows).mapInArrow(_cut, "label int, segment binary").distinct()
    taken: dict[int, list[bytes]] = {}
    for label in (0, 1):
        least = cut.filter(F.col("label") == label).orderBy(F.xxhash64("segment"), "segment").limit(FIT_SEGMENTS)
        taken[label] = [bytes(r.segment) for r in least.select("segment").collect()]
    even = min(map(len, taken.values())) or FIT_SEGMENTS  # a longer dictionary text would win by its length alone
    model = QualityModel(dictionary(taken[1][:even]), dictionary(taken[0][:even]))
    judged = score(_sample(texts, held, rows), model).select("label", "_saved", "_length")
    per_byte = F.col("_saved") / F.greatest("_length", F.lit(1))
    mean = judged.agg(F.avg(F.round(per_byte, 9).cast("decimal(18,9)"))).first()[0]  # exact, whatever the order of the rows
    model = model._replace(mean=float(mean or 0))
    drawn = (F.col("_saved") + DAMPING * model.mean) / (F.col("_length") + DAMPING)
    bins = judged.groupBy("label", F.round(drawn / _STEP).cast("long").alias("bin")).count().collect()
    values, labels, counts = (np.array([r[k] for r in sorted(bins)], float) for k in ("bin", "label", "count"))
    slope, intercept = curve(values * _STEP, labels, counts)
    return model._replace(slope=slope, intercept=intercept)


def _scored(shared, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: QualityModel = shared.value
        good, bad = Sizer(model.good), Sizer(model.bad)
        for batch in batches:
            saved, length = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            texts = batch.column(batch.schema.get_field_index(text_col))
            for k, text in enumerate(texts):
                value = text.as_py()
                content = value.encode() if isinstance(value, str) else value or b""
                saved[k], length[k] = bytes_saved(content, good, bad), len(content)
            found = model.difference(saved, length)
            columns = {name: c for name, c in zip(batch.schema.names, batch.columns) if name not in _ADDED}
            columns |= {"_saved": pa.array(saved), "_length": pa.array(length), "_difference": pa.array(found), "_score": pa.array(model.score(found))}
            yield pa.RecordBatch.from_pydict(columns)
    return run


def score(docs: DataFrame, model: QualityModel, text_col: str = "text") -> DataFrame:
    """``docs`` with ``_saved`` and ``_length`` in bytes, ``_difference`` and ``_score``, the probability of label 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name not in _ADDED]
    return docs.mapInArrow(_scored(shared, text_col), ", ".join([*fields, "_saved long", "_length long", "_difference double", "_score double"]))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    fold = remainder("doc_id", 4)
    model = fit(docs, labels.filter(fold < 2), labels.filter(fold == 3))
    return score(docs, model).select(
        "doc_id", (fold == 2).alias("held_out"), F.col("_score").alias("score"),
        (F.col("_score") >= 0.7).cast("int").alias("predicted"), F.col("_difference").alias("difference"))
