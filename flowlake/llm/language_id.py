"""Language identification of mixed-language texts.

A word is a run of letters. Its script, found by code point ranges, narrows the candidates to the languages
that were seen to use that script; each candidate scores the word by the log probabilities of its letters, each
with its neighbours, under that language's letter statistics. A Viterbi path over the words, in which a change
of language costs ``SWITCH``, labels spans; the language of most letters is the text's, its share of the letters
the score.

The statistics are counted over all training rows and hashed to ``BUCKETS`` numbers per language, so the model
that is broadcast has a fixed size per language.

Edge cases: a null text or one without letters is ``und`` with score 0; rows without a language are not learned
from; letters of a script that no language uses do not speak for any, and a text of only such letters gets the
language with most training letters; with no training rows every text with letters is ``und``; ties go to the
language that sorts first.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlake.llm import kernels as K

BUCKETS = 1 << 18
#: Bytes of text that are worked on together: letters and words take some fifty times their bytes meanwhile.
SLICE_BYTES = 1 << 18
#: What a change of language costs, in nats.
SWITCH = 14.0
#: A language is a candidate for a script that has at least this share of its training letters.
SCRIPT_SHARE = 0.005
MOST_LANGUAGES = 512
_SMOOTH = 0.2
_NOT_A_CANDIDATE = -40.0

#: Fixed values of Unicode: first code points of ranges, each up to the next, and their script.
_RANGES = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"),
    (0x0600, "arabic"), (0x0700, "other"), (0x0750, "arabic"), (0x0780, "other"), (0x0900, "devanagari"),
    (0x0980, "bengali"), (0x0A00, "gurmukhi"), (0x0A80, "gujarati"), (0x0B00, "oriya"), (0x0B80, "tamil"),
    (0x0C00, "telugu"), (0x0C80, "kannada"), (0x0D00, "malayalam"), (0x0D80, "sinhala"), (0x0E00, "thai"),
    (0x0E80, "lao"), (0x0F00, "tibetan"), (0x1000, "myanmar"), (0x10A0, "georgian"), (0x1100, "hangul"),
    (0x1200, "ethiopic"), (0x13A0, "other"), (0x1780, "khmer"), (0x1800, "mongolian"), (0x18B0, "other"),
    (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x2C60, "latin"), (0x2C80, "other"),
    (0x3040, "kana"), (0x3100, "han"), (0x3130, "hangul"), (0x3190, "han"), (0xA000, "other"), (0xA720, "latin"),
    (0xA800, "other"), (0xAC00, "hangul"), (0xD800, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB13, "armenian"),
    (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFE00, "other"), (0xFE70, "arabic"), (0xFF00, "latin"), (0xFF66, "kana"),
    (0xFFA0, "hangul"), (0x10000, "other"), (0x20000, "han"), (0x32000, "other"),
]
SCRIPTS = list(dict.fromkeys(name for _, name in _RANGES))
_TABLE = 0x32400
_tables: dict[str, tuple] = K.Cache()


def _letters() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By code point: whether it is a letter, its lower case, its script."""
    if "letters" not in _tables:
        points = [chr(c) for c in range(_TABLE)]
        lower = np.arange(_TABLE, dtype=np.uint32)
        for c in range(_TABLE):
            small = points[c].lower()
            if len(small) == 1 and ord(small) < _TABLE:
                lower[c] = ord(small)
        script = np.zeros(_TABLE, np.uint8)
        for (low, name), high in zip(_RANGES, [low for low, _ in _RANGES[1:]] + [_TABLE]):
            script[low:high] = SCRIPTS.index(name)
        _tables["letters"] = np.array([unicodedata.category(p)[0] == "L" for p in points]), lower, script
    return _tables["letters"]


class LetterWords(NamedTuple):
    """Letters of a slice and the words they form: per letter its bucket; per word its row, first letter, script
    and first and last code point within the row."""
    bucket: np.ndarray
    row: np.ndarray
    first: np.ndarray
    size: np.ndarray
    script: np.ndarray
    start: np.ndarray


def letter_words(data: np.ndarray, offsets: np.ndarray) -> LetterWords:
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32)
    starts_point = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]
    places = starts_point[offsets]
    is_letter, lower, script = _letters()
    low = np.minimum(points, _TABLE - 1)
    inside = is_letter[low]
    before, after = np.zeros(len(points) + 1, bool), np.zeros(len(points) + 1, bool)
    before[1:], after[:-2] = inside, inside[1:] if len(points) else False
    before[places] = False
    after[places[places > 0] - 1] = False
    at = np.flatnonzero(inside)
    small = lower[low].astype(np.uint64)
    letter = small[at]
    left = np.where(before[at], small[at - 1], np.uint64(1))
    right = np.where(after[at], small[np.minimum(at + 1, max(len(points) - 1, 0))], np.uint64(2))
    value = (left * np.uint64(0x9E3779B97F4A7C15) + letter) * np.uint64(0xC2B2AE3D27D4EB4F) + right
    value = value * np.uint64(0x165667B19E3779F9)
    bucket = (value >> np.uint64(64 - 18)).astype(np.int64)
    first = np.flatnonzero(~before[at])
    start = at[first]
    size = np.diff(np.r_[first, len(at)])
    row = np.searchsorted(places, start, "right") - 1
    return LetterWords(bucket, row, first, size, script[low[start]], start - places[row])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = batch.column(0).to_pylist()
        for low, high, data, offsets in K.text_slices(batch.column(1), SLICE_BYTES):
            found = letter_words(data, offsets)
            names, code = np.unique(np.array(langs[low:high], object).astype(str), return_inverse=True)
            word_lang = code[found.row]
            letter_lang = np.repeat(word_lang, found.size)
            for k, name in enumerate(names):
                total = totals.setdefault(str(name), np.zeros(BUCKETS + len(SCRIPTS), np.int64))
                total[:BUCKETS] += np.bincount(found.bucket[letter_lang == k], minlength=BUCKETS)
                own = word_lang == k
                total[BUCKETS:] += np.bincount(found.script[own], found.size[own], len(SCRIPTS)).astype(np.int64)
    for name, total in totals.items():
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"lang": pa.array([name] * len(seen), pa.string()), "bucket": pa.array(seen.astype(np.int32)),
                                          "n": pa.array(total[seen])})


class LanguageModel(NamedTuple):
    """Languages, their bucket log probabilities (bucket x language), candidates (script x language), letters seen."""
    languages: list[str]
    weights: np.ndarray
    candidates: np.ndarray
    letters: np.ndarray


def fit(training: DataFrame, lang_col: str = "lang", text_col: str = "text") -> LanguageModel:
    """Count the letter statistics of all rows that have a language."""
    rows = training.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    counted = rows.mapInArrow(K.releasing(_count, _tables), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    # at most a row per language and bucket
    table = counted.toPandas()
    languages = sorted(table["lang"].unique())
    if len(languages) > MOST_LANGUAGES:
        raise ValueError(f"{len(languages)} languages; the model holds {MOST_LANGUAGES}")
    counts = np.zeros((BUCKETS + len(SCRIPTS), len(languages)))
    counts[table["bucket"], [languages.index(x) for x in table["lang"]]] = table["n"]
    scripts, counts = counts[BUCKETS:], counts[:BUCKETS]
    letters = counts.sum(0)
    known = max(1, int((counts.sum(1) > 0).sum()))
    weights = np.log((counts + _SMOOTH) / (letters + _SMOOTH * known))
    return LanguageModel(languages, weights.astype(np.float32), scripts >= np.maximum(SCRIPT_SHARE * letters, 1), letters)


def viterbi(scores: np.ndarray, switch: float) -> np.ndarray:
    """The best label of every row of ``scores`` (words x labels) if a change of label costs ``switch``."""
    count = scores.shape[1]
    labels = range(count)
    value = scores[0].tolist()
    back = []
    for row in scores[1:].tolist():
        best = max(labels, key=value.__getitem__)
        changed = value[best] - switch
        back.append([k if value[k] >= changed else best for k in labels])
        value = [(v if v >= changed else changed) + s for v, s in zip(value, row)]
    label = max(labels, key=value.__getitem__)
    path = [label]
    for step in reversed(back):
        label = step[label]
        path.append(label)
    return np.array(path[::-1])


def label_words(model: LanguageModel, found: LetterWords, switch: float = SWITCH) -> np.ndarray:
    """The language number of every word.

    A text whose words never speak for another language by more than half the cost of a change, in any run,
    keeps its best language throughout; only the others need the path.
    """
    if not len(found.row):
        return np.zeros(0, np.int64)
    scores = np.add.reduceat(model.weights[found.bucket], found.first, axis=0).astype(np.float64)
    candidates = model.candidates[found.script]
    scores[~candidates] = _NOT_A_CANDIDATE * np.repeat(found.size, (~candidates).sum(1))
    scores[~candidates.any(1)] = 0.0
    rows, begin = np.unique(found.row, return_index=True)
    main = np.add.reduceat(scores, begin, axis=0)
    none = ~np.logical_or.reduceat(candidates.any(1), begin)
    main[none] = model.letters
    main = main.argmax(1)
    length = np.diff(np.r_[begin, len(found.row)])
    of_word = np.repeat(np.arange(len(rows)), length)
    label = main[of_word]
    ahead = scores - scores[np.arange(len(label)), label][:, None]
    total = np.cumsum(ahead, 0)
    earlier = total - ahead
    apart = 4 * np.abs(total).max() + 1  # keeps the running minimum of one text out of the next
    total, earlier = total - (of_word * apart)[:, None], earlier - (of_word * apart)[:, None]
    gain = np.maximum.reduceat((total - np.minimum.accumulate(earlier, 0)).max(1), begin)
    for k in np.flatnonzero((gain > switch / 2) & ~none).tolist():
        own = slice(begin[k], begin[k] + length[k])
        label[own] = viterbi(scores[own], switch)
    return label


_ADDED = ("_lang", "_score", "_lang_spans")


def _predict(shared, text_col: str, with_spans: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: LanguageModel = shared.value
        for batch in batches:
            n = batch.num_rows
            best, share, spans = np.full(n, -1), np.zeros(n), [[] for _ in range(n)]
            for low, high, data, offsets in K.text_slices(batch.column(batch.schema.get_field_index(text_col)), SLICE_BYTES):
                found = letter_words(data, offsets)
                if not len(found.row) or not model.languages:
                    continue
                label = label_words(model, found)
                letters = np.zeros((high - low, len(model.languages)))
                np.add.at(letters, (found.row, label), found.size)
                total = letters.sum(1)
                best[low:high] = np.where(total > 0, letters.argmax(1), -1)
                share[low:high] = np.where(total > 0, letters.max(1) / np.maximum(total, 1), 0)
                if with_spans:
                    cut = np.flatnonzero(np.r_[True, (label[1:] != label[:-1]) | (found.row[1:] != found.row[:-1])])
                    last = np.r_[cut[1:], len(label)] - 1
                    for a, b in zip(cut.tolist(), last.tolist()):
                        spans[low + int(found.row[a])].append({"lang": model.languages[label[a]], "first": int(found.start[a]),
                                                               "last": int(found.start[b] + found.size[b])})
            columns = {name: c for name, c in zip(batch.schema.names, batch.columns) if name not in _ADDED}
            columns["_lang"] = pa.array([model.languages[k] if k >= 0 else "und" for k in best], pa.string())
            columns["_score"] = pa.array(share)
            if with_spans:
                columns["_lang_spans"] = pa.array(spans, pa.list_(pa.struct([("lang", pa.string()), ("first", pa.int64()), ("last", pa.int64())])))
            yield pa.RecordBatch.from_pydict(columns)
    return run


def predict(docs: DataFrame, model: LanguageModel, text_col: str = "text", with_spans: bool = False) -> DataFrame:
    """``docs`` with ``_lang``, ``_score`` and, if asked for, ``_lang_spans`` (language, code point range), which take
    the place of columns of these names."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name not in _ADDED] + ["_lang string", "_score double"]
    fields += ["_lang_spans array<struct<lang:string,first:long,last:long>>"] * with_spans
    return docs.mapInArrow(K.releasing(_predict(shared, text_col, with_spans), _tables), ", ".join(fields))


def remainder(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % modulus


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    held_out = remainder("doc_id", 4) == 2
    model = fit(docs.filter(~held_out))
    found = predict(docs.select("doc_id", "text"), model, with_spans=True)
    return found.select("doc_id", held_out.alias("held_out"), F.col("_lang").alias("lang_pred"), F.col("_score").alias("score"),
                        F.size("_lang_spans").alias("n_spans"))
