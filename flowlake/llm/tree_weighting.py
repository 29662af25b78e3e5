"""Language-model scores by context-tree weighting over bytes.

A text is coded as its lower-cased (A-Z) words ``[^\\x20\\x09-\\x0D]+``, each followed by a space, and one end
symbol. The context of a byte are the up to ``DEPTH`` bytes before it: those of its word, the space before, and
for the first ``HEAD`` bytes of a word also the last ``TAIL`` bytes of the word before. A byte is decomposed into
eight binary decisions; each decision of each context of each depth has a Krichevsky-Trofimov estimate from the
training counts, and the estimates of all depths along a context's path are mixed with the weights of the context
tree. A context that training never met takes no part in the mixture.

Everything that depends on the corpus stays distributed:

1. Texts are dealt to bundles of about ``BUNDLE_BYTES``. A bundle lists its distinct words, and the distinct joints
   where a word's tail meets the next word's head, once, with their training counts, and its texts as numbers of
   these words.
2. Counts are summed over bundles, by ranges of words. In the same way, bundles of neighbouring words and joints
   list their distinct contexts.
3. Contexts that share their last two bytes form a subtree, which one task weighs from the leaves up; the two
   levels above hold at most 65,280 decisions and are broadcast.
4. Scores of contexts return to the bundles of words, scores of words and joints to the bundles of texts.

Words and joints are matched between bundles by their bytes. Within a bundle words are told apart by 64-bit
hashes, of which two among a million meet with a chance of one in 4 * 10^7.

Edge cases: a null text is empty and has the end symbol as its only token; rows that repeat a doc_id are rows of
their own; without training rows every decision has probability one half and the base score is that of an
empty count table; an empty table gives an empty result; further columns are left aside.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlake.llm import kernels as K
from flowlake.session import cut_lineage

DEPTH = 5
HEAD, TAIL = 3, 2
BUNDLE_BYTES = 32 << 20
BUNDLE_WORDS = 400_000
_SPACE, _END = 0x20, 0x0A
#: Bytes of words as they are coded: A-Z lower-cased; NUL, which stands for "nothing here" in keys, has the place of A, which
#: no lower-cased word has any more.
CODED = K.LOWER.copy()
CODED[0] = 0x41
_SPLIT = 2  # context bytes that name a subtree
_LEAST = np.log(0.5)


# -- bundles of texts ---------------------------------------------------------------------------------------

_TEXT_FIELDS = "bundle long, doc_id long, held_out boolean, low binary, high binary, word binary, number int, n long"


def _bundles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    task = K.partition() << 24
    done, held, parts = 0, 0, []
    for batch in batches:
        for low, high, data, offsets in K.text_slices(batch.column(2)):
            found = K.words(data, offsets, K.NOT_SPACE)
            ids = batch.column(0).slice(low, high - low)
            held_out = batch.column(1).slice(low, high - low).to_numpy(zero_copy_only=False).astype(bool)
            sizes = np.bincount(found.row, minlength=high - low)
            value, first, code = np.unique(found.hash, return_index=True, return_inverse=True)
            listed = K.binary_rows(CODED[data], found.start[first], found.end[first])
            parts.append((ids, held_out, sizes, value, listed, code.astype(np.int32), _joints(data, found, sizes, held_out)))
            held += len(data)
            if held >= BUNDLE_BYTES:
                yield from _bundle(task + done, parts)
                done, held, parts = done + 1, 0, []
    if parts:
        yield from _bundle(task + done, parts)


def edges(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Of the words [start, end): the last two bytes (the last one lower) above the first three coded bytes."""
    size = end - start
    last = max(len(data) - 1, 0)

    def byte(at: np.ndarray, there: np.ndarray, else_: np.ndarray) -> np.ndarray:
        return np.where(there, data[np.clip(at, 0, last)], else_).astype(np.uint64) if len(at) else np.zeros(0, np.uint64)

    space = np.full(len(start), _SPACE)
    head = ((byte(start, size > 0, space) << np.uint64(16)) | (byte(start + 1, size > 1, space) << np.uint64(8))
            | byte(start + 2, size > 2, np.where(size == 2, _SPACE, 0)))
    tail = (byte(end - 2, size > 1, space) << np.uint64(8)) | byte(end - 1, size > 0, space)
    return (tail << np.uint64(24)) | head


_HEAD_BITS = np.uint64((1 << 24) - 1)
_END_HEAD = np.uint64(_END << 16)


def joint_keys(edge: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The joints of texts with ``sizes`` words: each word's head below the tail before it (0 at the beginning),
    and after each text's words the end symbol below the last tail."""
    before = np.zeros(len(edge) + len(sizes), np.uint64)
    head = np.full(len(before), _END_HEAD)
    place = np.arange(len(edge)) + np.repeat(np.arange(len(sizes)), sizes)
    head[place] = edge & _HEAD_BITS
    before[place + 1] = edge & ~_HEAD_BITS
    return before | head


def _joints(data: np.ndarray, found: K.Words, sizes: np.ndarray, held_out: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, training count) of the distinct joints of a slice."""
    key, code = np.unique(joint_keys(edges(CODED[data], found.start, found.end), sizes), return_inverse=True)
    return key, np.bincount(code, np.repeat(~held_out, sizes + 1), len(key)).astype(np.int64)


def _bundle(number: int, parts: list) -> Iterator[pa.RecordBatch]:
    """The rows of a bundle. A part is a slice: ids, held out, words per text, distinct words as hashes and as bytes,
    the texts as numbers of the slice's distinct words, joints."""
    sizes = np.concatenate([p[2] for p in parts])
    held_out = np.concatenate([p[1] for p in parts])
    ids = pa.chunked_array([p[0] for p in parts]).combine_chunks()
    value, first, places = np.unique(np.concatenate([p[3] for p in parts]), return_index=True, return_inverse=True)
    bounds = np.cumsum([0, *(len(p[3]) for p in parts)])
    code = np.concatenate([places[a:b].astype(np.int32)[p[5]] for p, a, b in zip(parts, bounds, bounds[1:])])
    trained = np.bincount(code[np.repeat(~held_out, sizes)], minlength=len(value))
    by_use = np.argsort(-np.bincount(code, minlength=len(value)), kind="stable")  # frequent words get small numbers, which take little room
    rank = np.empty(len(value), np.int32)
    rank[by_use] = np.arange(len(value))
    code = rank[code]
    words = pa.chunked_array([p[4] for p in parts]).combine_chunks().take(pa.array(first))
    low, high = (code & 0xFFFF).astype("<u2"), (code >> 16).astype(np.uint8 if len(value) < 1 << 24 else "<u4")
    ends = np.cumsum(sizes)
    for a in range(0, len(sizes), 4096):
        b = min(a + 4096, len(sizes))
        spans = list(zip((ends[a:b] - sizes[a:b]).tolist(), ends[a:b].tolist()))
        yield _filled(b - a, number, doc_id=ids.slice(a, b - a), held_out=pa.array(held_out[a:b]),
                      low=pa.array([low[x:y].tobytes() for x, y in spans], pa.binary()),
                      high=pa.array([high[x:y].tobytes() for x, y in spans], pa.binary()))
    by_word = pa.compute.sort_indices(words)  # neighbours share bytes, which a shuffle by ranges packs well
    words, rank, trained = words.take(by_word), rank[by_word.to_numpy()], trained[by_word.to_numpy()]
    for a in range(0, len(value), 50_000):
        b = min(a + 50_000, len(value))
        yield _filled(b - a, number, word=words.slice(a, b - a), number=pa.array(rank[a:b].astype(np.int32)), n=pa.array(trained[a:b]))
    yield _filled(1, number, word=pa.array([bytes([_END])], pa.binary()),
                  number=pa.array([len(value)], pa.int32()), n=pa.array([int((~held_out).sum())]))
    joint, code = np.unique(np.concatenate([p[6][0] for p in parts]), return_inverse=True)
    trained = np.bincount(code, np.concatenate([p[6][1] for p in parts]), len(joint)).astype(np.int64)
    for a in range(0, len(joint), 50_000):
        yield _filled(len(joint[a:a + 50_000]), number, word=_joint_bytes(joint[a:a + 50_000]), n=pa.array(trained[a:a + 50_000]))


def _joint_bytes(joint: np.ndarray) -> pa.Array:
    """Joints as binary: a space, which no word has, and their five bytes."""
    value = (joint | np.uint64(_SPACE << 40)).astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:]
    start = np.arange(len(joint)) * 6
    return K.binary_rows(np.ascontiguousarray(value).reshape(-1), start, start + 6)


def _split(listed: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Which of the listed binaries are joints, the words among the others, and the joints' keys."""
    raw, offsets = _word_bytes(listed)
    is_joint = np.zeros(len(listed), bool)
    some = offsets[1:] > offsets[:-1]
    is_joint[some] = raw[offsets[:-1][some]] == _SPACE
    joint = np.zeros(int(is_joint.sum()), np.uint64)
    for k in range(1, 6):
        joint = (joint << np.uint64(8)) | raw[offsets[:-1][is_joint] + k]
    return is_joint, listed.filter(pa.array(~is_joint)), joint


_TYPES = {"doc_id": pa.int64(), "held_out": pa.bool_(), "low": pa.binary(), "high": pa.binary(),
          "word": pa.binary(), "number": pa.int32(), "n": pa.int64()}


def _filled(rows: int, bundle: int, **columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"bundle": pa.array(np.full(rows, bundle))} | {
        name: columns[name] if name in columns else pa.nulls(rows, kind) for name, kind in _TYPES.items()})


# -- byte contexts of words and joints ----------------------------------------------------------------------

def _word_bytes(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a binary array."""
    _, at, data = words.buffers()
    offsets = np.frombuffer(at, np.int32)[words.offset: words.offset + len(words) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0]: offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def word_grams(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(word number, gram) of every coded byte of ``words`` from the HEAD-th on. A gram has the byte in its lowest
    eight bits and its context above, the byte before topmost; before the word is a space, further back nothing."""
    raw, offsets = _word_bytes(words)
    length = np.diff(offsets)
    number = np.repeat(np.arange(len(words)), length + 1)
    begin = offsets[:-1] + np.arange(len(words))
    place = np.arange(len(number)) - begin[number]
    coded = np.full(len(number), _SPACE, np.uint64)
    coded[place < length[number]] = raw
    at = np.flatnonzero(place >= HEAD)
    place = place[at]
    key = coded[at]
    for back in range(1, DEPTH + 1):
        earlier = np.where(place >= back, coded[np.maximum(at - back, 0)], np.where(place == back - 1, np.uint64(_SPACE), np.uint64(0)))
        key |= earlier << np.uint64(8 * (DEPTH + 1 - back))
    return number[at], key


def joint_grams(joint: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(joint number, gram) of the coded bytes of the heads."""
    before, last = (joint >> np.uint64(32)) & np.uint64(0xFF), (joint >> np.uint64(24)) & np.uint64(0xFF)
    space = np.where(last > 0, np.uint64(_SPACE), np.uint64(0))
    heads = [(joint >> np.uint64(shift)) & np.uint64(0xFF) for shift in (16, 8, 0)]
    numbers, keys = [], []
    for k, byte in enumerate(heads):
        context = [*reversed(heads[:k]), space, last, before][:DEPTH]
        key = byte.copy()
        for back, value in enumerate(context, 1):
            key |= value << np.uint64(8 * (DEPTH + 1 - back))
        coded = np.flatnonzero(byte > 0)
        if k:  # the end symbol has nothing after it, and a NUL byte in a head is never a coded one's predecessor
            coded = coded[heads[0][coded] != _END]
        numbers.append(coded)
        keys.append(key[coded])
    return np.concatenate(numbers), np.concatenate(keys)


def _grams(listed: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, gram) of listed words and joints."""
    is_joint, words, joint = _split(listed)
    number, key = word_grams(words)
    other, more = joint_grams(joint)
    return np.concatenate([np.flatnonzero(~is_joint)[number], np.flatnonzero(is_joint)[other]]), np.concatenate([key, more])


_WORD_FIELDS = "bundle long, word binary, c long, gram long, n long"


_CHUNK = 50_000


def _counted_grams(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(gram, training count) of the distinct grams of some words and joints."""
    row, key = _grams(table.column("word").combine_chunks())
    value, code = np.unique(key, return_inverse=True)
    return value, np.bincount(code, table.column("c").to_numpy()[row].astype(float), len(value))


def _word_bundles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    task = K.partition() << 24
    done, held, parts = 0, 0, []

    def out() -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(parts)
        listed = [_counted_grams(table.slice(a, _CHUNK)) for a in range(0, table.num_rows, _CHUNK)]
        value, code = np.unique(np.concatenate([x[0] for x in listed]), return_inverse=True)
        n = np.bincount(code, np.concatenate([x[1] for x in listed]), len(value)).astype(np.int64)
        for a in range(0, len(value), 100_000):
            rows = len(value[a:a + 100_000])
            yield pa.RecordBatch.from_pydict({
                "bundle": pa.array(np.full(rows, task + done)), "word": pa.nulls(rows, pa.binary()), "c": pa.nulls(rows, pa.int64()),
                "gram": K.signed(value[a:a + 100_000]), "n": pa.array(n[a:a + 100_000])})
        none = pa.nulls(table.num_rows, pa.int64())
        yield pa.RecordBatch.from_pydict({"bundle": pa.array(np.full(table.num_rows, task + done)), "word": table.column("word").combine_chunks(),
                                          "c": table.column("c").combine_chunks(), "gram": none, "n": none})

    for batch in batches:
        for a in range(0, batch.num_rows, BUNDLE_WORDS):
            parts.append(batch.slice(a, BUNDLE_WORDS))
            held += parts[-1].num_rows
            if held >= BUNDLE_WORDS:
                yield from out()
                done, held, parts = done + 1, 0, []
    if held:
        yield from out()


# -- the weighted tree --------------------------------------------------------------------------------------

def _log_gamma(x: np.ndarray) -> np.ndarray:
    """log of the gamma function for x >= 1/2: Stirling's series eight places further, and back."""
    y = x + 8.0
    series = (1 / 12 - (1 / 360 - (1 / 1260 - 1 / (1680 * y * y)) / (y * y)) / (y * y)) / y
    back = np.log(x * (x + 1) * (x + 2) * (x + 3)) + np.log((x + 4) * (x + 5) * (x + 6) * (x + 7))
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + series - back


def kt_log(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """log probability that the Krichevsky-Trofimov estimator gives a sequence of a zeros and b ones."""
    return _log_gamma(a + 0.5) + _log_gamma(b + 0.5) - _log_gamma(a + b + 1.0) - np.log(np.pi)


class Decisions:
    """The binary decisions of all contexts of one depth: sorted keys (context, decision), counts, weighted log probability."""

    def __init__(self, key: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray | None):
        self.key, self.zeros, self.ones = key, zeros, ones
        self.kt = kt_log(zeros, ones)
        self.weighted = self.kt if below is None else np.logaddexp(_LEAST + self.kt, _LEAST + below)
        self.stop = np.exp(np.minimum(self.kt - self.weighted + (0 if below is None else _LEAST), 0))

    def mixed(self, key: np.ndarray, bit: np.ndarray, below: np.ndarray) -> np.ndarray:
        """Probability of ``bit``, given that of the next depth (nan where training has not met it)."""
        if not len(self.key):
            return np.full(len(key), np.nan)
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        own = (np.where(bit, self.ones[at], self.zeros[at]) + 0.5) / (self.zeros[at] + self.ones[at] + 1.0)
        value = np.where(np.isnan(below), own, self.stop[at] * own + (1 - self.stop[at]) * below)
        return np.where(self.key[at] == key, value, np.nan)


def _summed(key: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    found, code = np.unique(key, return_inverse=True)
    return found, *(np.bincount(code, v, len(found)) for v in values)


def _counted(gram: np.ndarray, n: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context << 8 | decision, zeros, ones) of the contexts of ``depth`` bytes."""
    context = _context(gram, depth)
    byte = gram & np.uint64(0xFF)
    pair, total = _summed((context << np.uint64(8)) | byte, n)
    context, byte = pair >> np.uint64(8), pair & np.uint64(0xFF)
    keys, bits = zip(*((_decision(context, byte, level), (byte >> np.uint64(7 - level)) & np.uint64(1)) for level in range(8)))
    key, bit, many = np.concatenate(keys), np.concatenate(bits), np.tile(total, 8)
    return _summed(key, many * (bit == 0), many * (bit == 1))


def _context(gram: np.ndarray, depth: int) -> np.ndarray:
    return gram >> np.uint64(8 * (DEPTH + 1 - depth)) if depth else np.zeros(len(gram), np.uint64)


def _decision(context: np.ndarray, byte: np.ndarray, level: int) -> np.ndarray:
    return (context << np.uint64(8)) | np.uint64(1 << level) | (byte >> np.uint64(8 - level))


def _parents(key: np.ndarray) -> np.ndarray:
    """The same decision one context byte shorter."""
    return ((key >> np.uint64(16)) << np.uint64(8)) | (key & np.uint64(0xFF))


def subtree(gram: np.ndarray, n: np.ndarray) -> dict[int, Decisions]:
    """Depths ``_SPLIT`` to DEPTH of the tree over trained grams."""
    depths: dict[int, Decisions] = {}
    trained = n > 0
    for depth in range(DEPTH, _SPLIT - 1, -1):
        key, zeros, ones = _counted(gram[trained], n[trained].astype(float), depth)
        below = None
        if depth < DEPTH:
            lower = depths[depth + 1]
            below = np.bincount(np.searchsorted(key, _parents(lower.key)), lower.weighted, len(key))
        depths[depth] = Decisions(key, zeros, ones, below)
    return depths


def byte_log10(gram: np.ndarray, tree: dict[int, Decisions]) -> np.ndarray:
    """log10 probability of every gram's byte in its context, over the depths of ``tree`` (0 to DEPTH)."""
    byte = gram & np.uint64(0xFF)
    total = np.zeros(len(gram))
    for level in range(8):
        bit = (byte >> np.uint64(7 - level)) & np.uint64(1) == 1
        p = np.full(len(gram), np.nan)
        for depth in range(DEPTH, -1, -1):
            p = tree[depth].mixed(_decision(_context(gram, depth), byte, level), bit, p)
        total += np.log10(np.where(np.isnan(p), 0.5, p))
    return total


def _subtree_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for table in K.streamed_groups(batches, ["tree"]):
        yield table.column("gram").to_numpy().view(np.uint64), table.column("n").to_numpy()


def _weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the levels above need of each subtree: counts and weighted probability of its root's decisions."""
    for gram, n in _subtree_groups(batches):
        root = subtree(gram, n)[_SPLIT]
        yield pa.RecordBatch.from_pydict({"key": K.signed(_parents(root.key)), "zeros": pa.array(root.zeros.astype(np.int64)),
                                          "ones": pa.array(root.ones.astype(np.int64)), "weighted": pa.array(root.weighted)})


def _score_grams(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for gram, n in _subtree_groups(batches):
            yield pa.RecordBatch.from_pydict({"gram": K.signed(gram), "log10": pa.array(byte_log10(gram, subtree(gram, n) | shared.value))})
    return run


def _top(roots: DataFrame) -> dict[int, Decisions]:
    """Depths 0 and 1 from the subtrees' roots; at most 256 contexts of 255 decisions."""
    table = roots.groupBy("key").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("weighted").alias("weighted")).toPandas()
    key = table["key"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(key)
    zeros, ones, below = (table[c].to_numpy(float)[order] for c in ("zeros", "ones", "weighted"))
    one = Decisions(key[order], zeros, ones, below)
    return {1: one, 0: Decisions(*_summed(_parents(one.key), zeros, ones, one.weighted))}


# -- scores -------------------------------------------------------------------------------------------------

def _score_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of words and joints: log10 probability of their coded bytes; of words also their edges."""
    for table in K.streamed_groups(batches, ["bundle"]):
        is_gram = table.column("log10").is_valid()
        scored, items = table.filter(is_gram), table.filter(pa.compute.invert(is_gram))
        gram = scored.column("gram").to_numpy().view(np.uint64)
        order = np.argsort(gram)
        gram, log10 = gram[order], scored.column("log10").to_numpy()[order]
        for a in range(0, items.num_rows, _CHUNK):
            part = items.slice(a, _CHUNK)
            listed = part.column("word").combine_chunks()
            row, key = _grams(listed)
            value = log10[np.searchsorted(gram, key)] if len(key) else np.zeros(0)
            is_joint, words, joint = _split(listed)
            raw, offsets = _word_bytes(words)
            edge = np.zeros(part.num_rows, np.uint64)
            edge[~is_joint], edge[is_joint] = edges(raw, offsets[:-1], offsets[1:]), joint
            yield pa.RecordBatch.from_pydict({"word": listed, "c": part.column("c").combine_chunks(),
                                              "log10": pa.array(np.bincount(row, value, part.num_rows)), "edge": K.signed(edge)})


def _score_texts(total: int, distinct: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in K.streamed_groups(batches, ["bundle"]):
            is_text, is_word = table.column("low").is_valid(), table.column("number").is_valid()
            texts, words = table.filter(is_text), table.filter(is_word)
            joints = table.filter(pa.compute.invert(pa.compute.or_(is_text, is_word)))
            order = np.argsort(words.column("number").to_numpy())
            c, log10 = words.column("c").to_numpy()[order], words.column("log10").to_numpy()[order]
            edge = words.column("edge").to_numpy().view(np.uint64)[order]
            key = joints.column("edge").to_numpy().view(np.uint64)
            by_key = np.argsort(key)
            key, joint_log10 = key[by_key], joints.column("log10").to_numpy()[by_key]
            base = np.log10((c + 0.5) / (total + 0.5 * (distinct + 1)))
            end, wide = len(c) - 1, np.dtype(np.uint8 if len(c) - 1 < 1 << 24 else "<u4")  # the end symbol has the last number
            lows, highs = texts.column("low").to_pylist(), texts.column("high").to_pylist()
            for a in range(0, len(lows), 1024):
                sizes = np.array([len(x) // 2 for x in lows[a:a + 1024]])
                rows = len(sizes)
                code = np.frombuffer(b"".join(lows[a:a + 1024]), "<u2").astype(np.int64)
                code |= np.frombuffer(b"".join(highs[a:a + 1024]), wide).astype(np.int64) << 16
                row = np.repeat(np.arange(rows), sizes)
                met = joint_log10[np.searchsorted(key, joint_keys(edge[code], sizes))]
                score = np.bincount(row, log10[code], rows) + np.bincount(np.repeat(np.arange(rows), sizes + 1), met, rows)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": texts.column("doc_id").slice(a, rows).combine_chunks(), "held_out": texts.column("held_out").slice(a, rows).combine_chunks(),
                    "n_tokens": pa.array(sizes + 1), "n_known": pa.array((np.bincount(row, c[code] > 0, rows) + (c[end] > 0)).astype(np.int64)),
                    "train_tokens": pa.array(np.full(rows, total)), "base_score": pa.array(np.bincount(row, base[code], rows) + base[end]),
                    "score": pa.array(score)})
    return run


def scores(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from the rows that are not ``held_out``.
    """
    spark = docs.sparkSession
    bundles = cut_lineage(docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out.alias("held_out"), F.col(text_col).alias("text"))
                          .mapInArrow(_bundles, _TEXT_FIELDS), "bundles")
    listed = bundles.filter("word IS NOT NULL").select("bundle", "word", "number", "n")
    counted = listed.select("word", "n").repartitionByRange("word").groupBy("word").agg(F.sum("n").alias("c"))
    fewer = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // 4)  # larger bundles list a context less often
    items = cut_lineage(counted.coalesce(fewer).mapInArrow(_word_bundles, _WORD_FIELDS), "items")
    is_word = F.substring("word", 1, 1) != F.lit(bytes([_SPACE]))
    row = items.filter("word IS NOT NULL").filter(is_word).agg(F.sum("c"), F.count(F.when(F.col("c") > 0, 1))).first()
    total, distinct = int(row[0] or 0), int(row[1])

    requests = items.filter("gram IS NOT NULL").select("bundle", "gram", "n")
    trees = cut_lineage(requests.groupBy("gram").agg(F.sum("n").alias("n"))
                        .withColumn("tree", F.shiftrightunsigned("gram", 8 * (DEPTH + 1 - _SPLIT))), "grams")
    trees = trees.repartition("tree").sortWithinPartitions("tree")
    shared = spark.sparkContext.broadcast(_top(trees.mapInArrow(_weigh, "key long, zeros long, ones long, weighted double")))
    gram_scores = trees.mapInArrow(_score_grams(shared), "gram long, log10 double")

    def empty(**kinds: str) -> list[Column]:
        return [F.lit(None).cast(kind).alias(name) for name, kind in kinds.items()]

    replies = requests.select("bundle", "gram").join(gram_scores, "gram").select(
        "bundle", "gram", "log10", *empty(word="binary", c="long"))
    asked = items.filter("gram IS NULL").select("bundle", *empty(gram="long", log10="double"), "word", "c")
    scored = (replies.unionByName(asked).repartition("bundle").sortWithinPartitions("bundle")
              .mapInArrow(_score_items, "word binary, c long, log10 double, edge long"))
    text_only = {"doc_id": "long", "held_out": "boolean", "low": "binary", "high": "binary"}
    back = listed.select("bundle", "number", "word").join(scored, "word").select("bundle", "number", "c", "log10", "edge", *empty(**text_only))
    texts = bundles.filter("word IS NULL").select("bundle", *empty(number="int", c="long", log10="double", edge="long"), *text_only)
    return (back.unionByName(texts).repartition("bundle").sortWithinPartitions("bundle").mapInArrow(
        _score_texts(total, distinct),
        "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    key = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    return scores(docs, key % 5 == 1)
