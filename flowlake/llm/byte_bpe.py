"""Byte-level BPE encoding by a lazily determinised transducer, and streaming decoding.

For every prefix of a piece the last token of its encoding is unique: it is the token that ends there and whose
pair with the last token of what precedes it stays unmerged. So the transducer's state after some bytes is the
longest suffix that can still grow into a token, with the last tokens at those positions of it where a token
can start. States
and transitions are made when first met. Tokens are written once all positions from which a later token can
start agree on them, which is at most one token length behind the input.

Transitions lie in one flat hash table. Pieces that a run of texts brings and the caches lack step through it together,
one byte of each at a time; a long piece goes alone.

Decoding lifts the UTF-8 state machine from bytes to tokens: its state is the bytes of an unfinished character.

Edge cases: null texts count as empty and have no tokens; texts are cut only where the pattern cuts them, and a
piece of any length is encoded in one go with memory for its undecided end; a piece that is a token as a whole
is that token, as in the public library; ids outside the vocabulary raise; invalid UTF-8 in ids decodes to
U+FFFD for each maximal part. Tables may have further columns.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import re
from array import array
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlake.llm import kernels as K

#: Cuts that a task keeps, half of them those met last, and entries after which its other caches start anew.
CACHE_PIECES = 400_000
CACHE_STATES = 1 << 18
#: Bytes of text whose pieces are encoded together; characters of a cut, or bytes of a piece, that is not kept and goes alone.
RUN_BYTES = 1 << 19
LONG = 64
_FLUSH = 4096
_SPREAD, _WORD = 0x9E3779B97F4A7C15, (1 << 64) - 1
_NEVER = 1 << 40
_BYTES = [bytes((value,)) for value in range(256)]


class Vocabulary:
    """Ranks of byte strings."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.growing = {token[:n] for token in ranks for n in range(1, len(token))}
        self.pairs: dict[int, bool] = {}
        self._reached: dict[int, bool] = {}
        self._edges: dict[tuple[int, int], list[tuple[bytes, int]]] = {}

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        with open(path, "rb") as lines:
            return cls({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)})

    def merged(self, piece: bytes, until: int = 1) -> list[bytes]:
        """The parts by the definition of the encoding: merge the neighbours of lowest rank, leftmost first,
        while there are more than ``until`` parts. For short input."""
        parts = [piece[k:k + 1] for k in range(len(piece))]
        while len(parts) > until:
            rank, at = min((self.ranks.get(a + b, _NEVER), k) for k, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank == _NEVER:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def reached(self, token: int) -> bool:
        """Whether merging the token's own bytes gives the token."""
        known = self._reached.get(token)
        if known is None:
            known = self._reached[token] = self.merged(self.tokens[token]) == [self.tokens[token]]
        return known

    def _edge(self, token: int, side: int) -> list[tuple[bytes, int]]:
        """The parts that lie at the token's left (0) or right (-1) end while it is merged, smallest first,
        each with the rank at which it becomes part of the next."""
        known = self._edges.get((token, side))
        if known is None:
            part, until, known = self.tokens[token], _NEVER, []
            while True:
                known.append((part, until))
                if len(part) == 1:
                    break
                part, until = self.merged(part, 2)[side], self.ranks[part]
            known.reverse()
            self._edges[token, side] = known
        return known

    def fits(self, left: int, right: int) -> bool:
        """Whether the two stay apart when they are neighbours.

        Merges run in order of rank, so they do unless two parts that lie at the border at the same time
        merge before either is merged into its own token; of equal ranks the one further left comes first.
        """
        pair = left << 32 | right
        known = self.pairs.get(pair)
        if known is None:
            if len(self.pairs) > CACHE_STATES:
                self.pairs.clear()
            before, after = self._edge(left, -1), self._edge(right, 0)
            i = k = 0
            known = True
            while True:
                (a, until_a), (b, until_b) = before[i], after[k]
                across = self.ranks.get(a + b, _NEVER)
                if across != _NEVER and across < until_a and across <= until_b:
                    known = False
                    break
                if until_a <= until_b:
                    i += 1
                else:
                    k += 1
                if i == len(before) or k == len(after):
                    break
            self.pairs[pair] = known
        return known


class Steps:
    """Target states by (state, byte), in an open hash table of flat arrays."""

    def __init__(self, bits: int = 20):
        self.shift, self.mask, self.count = 64 - bits, (1 << bits) - 1, 0
        self.keys = array("q", [-1]) * (1 << bits)
        self.targets = array("i", [0]) * (1 << bits)

    def _place(self, key: int) -> int:
        """Where the key is, or else the free place for it."""
        keys, at = self.keys, (key * _SPREAD & _WORD) >> self.shift
        while keys[at] != key and keys[at] >= 0:
            at = (at + 1) & self.mask
        return at

    def get(self, key: int) -> int:
        """The target, or -1."""
        at = self._place(key)
        return self.targets[at] if self.keys[at] >= 0 else -1

    def put(self, key: int, target: int) -> None:
        """Add a key that is not there."""
        if 2 * self.count > self.mask:
            old = [(k, t) for k, t in zip(self.keys, self.targets) if k >= 0]
            self.__init__(65 - self.shift)
            for k, t in old:
                self.put(k, t)
        at = self._place(key)
        self.keys[at], self.targets[at] = key, target
        self.count += 1

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """The targets of many keys, -1 for those that are not there."""
        keys, targets = np.frombuffer(self.keys, np.int64), np.frombuffer(self.targets, np.int32)
        at = ((wanted.view(np.uint64) * np.uint64(_SPREAD)) >> np.uint64(self.shift)).view(np.int64)
        there = keys[at]
        out = targets[at]
        open_ = np.flatnonzero(there != wanted)
        while len(open_):
            free = there[open_] < 0
            out[open_[free]] = -1
            open_ = open_[~free]
            at[open_] = (at[open_] + 1) & self.mask
            there[open_] = keys[at[open_]]
            hit = there[open_] == wanted[open_]
            out[open_[hit]] = targets[at[open_[hit]]]
            open_ = open_[~hit]
        return out


class Transducer:
    """Encodes pieces byte by byte. States and their steps are made when they are first entered."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self._length = np.zeros(max(vocabulary.tokens) + 1, np.int64)
        for token, value in vocabulary.tokens.items():
            self._length[token] = len(value)
        self._reset()

    def _reset(self) -> None:
        # a state's last tokens stand for the positions of its suffix where a token can start, and its end
        self._states = {(b"", (-1,)): 0}
        self._keys = [(b"", (-1,))]
        self._token = array("i", [-1])
        self._steps = Steps()
        self._grown: dict[bytes, tuple] = {}

    def _starts(self, suffix: bytes) -> list[int]:
        return [k for k in range(len(suffix)) if suffix[k:] in self.vocabulary.growing] + [len(suffix)]

    def _grow(self, suffix: bytes) -> tuple:
        """For a suffix with its newest byte: the tokens that end here, longest first, each with the index of
        its start among the starts before; the suffix to keep; the indexes of the starts to keep."""
        before = self._starts(suffix[:-1])
        tokens = [(k, self.vocabulary.ranks[suffix[start:]]) for k, start in enumerate(before)
                  if suffix[start:] in self.vocabulary.ranks]
        after = self._starts(suffix)[:-1]
        kept = suffix[after[0]:] if after else b""
        known = self._grown[suffix] = ([x for x in tokens if self.vocabulary.reached(x[1])], kept,
                                       [before.index(start) for start in after])
        return known

    def _enter(self, state: int, byte: int) -> int:
        suffix, last = self._keys[state]
        grown = suffix + _BYTES[byte]
        tokens, kept, starts = self._grown.get(grown) or self._grow(grown)
        vocabulary = self.vocabulary
        for start, token in tokens:
            before = last[start]
            if before < 0:
                break
            fits = vocabulary.pairs.get(before << 32 | token)
            if vocabulary.fits(before, token) if fits is None else fits:
                break
        else:
            raise ValueError(f"no token ends with byte {byte}")
        key = (kept, (*[last[k] for k in starts], token))
        target = self._states.get(key)
        if target is None:
            target = self._states[key] = len(self._keys)
            self._keys.append(key)
            self._token.append(token)
        self._steps.put(state << 8 | byte, target)
        return target

    def encode(self, piece: bytes) -> list[int]:
        """The token ids of one piece."""
        whole = self.vocabulary.ranks.get(piece)
        if whole is not None:
            return [whole]
        out: list[int] = []
        last: list[int] = []  # the last token at each position that is not yet written
        state = 0
        for byte in piece:
            target = self._steps.get(state << 8 | byte)
            state = self._enter(state, byte) if target < 0 else target
            last.append(self._token[state])
            if len(last) >= _FLUSH:
                last = self._write_decided(last, len(self._keys[state][0]), out)
                if len(self._keys) > 2 * CACHE_STATES:
                    state = self._restart(state)
        self._write(last, len(last), out)
        if len(self._keys) > CACHE_STATES:
            self._reset()
        return out

    def _restart(self, state: int) -> int:
        """Forget all states but this one; its new number."""
        key = self._keys[state]
        self._reset()
        if key not in self._states:
            self._states[key] = len(self._keys)
            self._keys.append(key)
            self._token.append(key[1][-1])
        return self._states[key]

    def encode_all(self, pieces: list[bytes]) -> list[list[int]]:
        """The token ids of each piece. Short pieces that are no tokens take each step together."""
        ranks = self.vocabulary.ranks
        out = [[ranks[p]] if p in ranks else self.encode(p) if len(p) > LONG else [] for p in pieces]
        at = sorted((k for k, ids in enumerate(out) if not ids and pieces[k]), key=lambda k: -len(pieces[k]))
        if not at:
            return out
        length = np.array([len(pieces[k]) for k in at])
        data = np.frombuffer(b"".join([pieces[k] for k in at]), np.uint8).astype(np.int64)
        begin = np.cumsum(length) - length
        last = np.zeros(len(data), np.int64)  # the last token at each position
        state, newest = np.zeros(len(at), np.int64), np.zeros(0, np.int64)
        for k in range(int(length[0])):
            going = int(np.searchsorted(-length, -k, "left"))  # longer than k
            place = begin[:going] + k
            wanted = state[:going] << 8 | data[place]
            state = self._steps.find(wanted).astype(np.int64)
            new = np.flatnonzero(state < 0)
            if len(new):
                keys, which = np.unique(wanted[new], return_inverse=True)
                state[new] = np.array([self._enter(x >> 8, x & 255) for x in keys.tolist()])[which]
            if len(newest) < len(self._keys):
                newest = np.array(self._token)
            last[place] = newest[state]
        starts = np.full(len(data), -1, np.int64)  # the token that starts at a position
        left, end = np.arange(len(at)), begin + length
        while len(left):
            token = last[end - 1]
            end = end - self._length[token]
            starts[end] = token
            more = end > begin[left]
            left, end = left[more], end[more]
        ids = starts[starts >= 0].tolist()
        bounds = np.concatenate([[0], np.cumsum(starts >= 0)[begin + length - 1]]).tolist()
        for k, low, high in zip(at, bounds, bounds[1:]):
            out[k] = ids[low:high]
        if len(self._keys) > CACHE_STATES:
            self._reset()
        return out

    def _write(self, last: list[int], end: int, out: list[int]) -> None:
        path = []
        while end > 0:
            path.append(last[end - 1])
            end -= len(self.vocabulary.tokens[last[end - 1]])
        out.extend(reversed(path))

    def _write_decided(self, last: list[int], live: int, out: list[int]) -> list[int]:
        """Write what every position that a later token may start from agrees on; the rest stays."""
        ends = set(range(len(last) - live, len(last) + 1))
        while len(ends) > 1:
            end = max(ends)
            ends.remove(end)
            ends.add(end - len(self.vocabulary.tokens[last[end - 1]]))
        decided = ends.pop()
        self._write(last, decided, out)
        return last[decided:]


_LEAD = [(0x00, 0x7F, 0, 0, 0), (0xC2, 0xDF, 1, 0x80, 0xBF), (0xE0, 0xE0, 2, 0xA0, 0xBF), (0xE1, 0xEC, 2, 0x80, 0xBF),
         (0xED, 0xED, 2, 0x80, 0x9F), (0xEE, 0xEF, 2, 0x80, 0xBF), (0xF0, 0xF0, 3, 0x90, 0xBF), (0xF1, 0xF3, 3, 0x80, 0xBF),
         (0xF4, 0xF4, 3, 0x80, 0x8F)]  # fixed values of UTF-8: first to last lead byte, bytes that follow, bounds of the first of them


class Utf8Stream:
    """Incremental UTF-8 decoding of token ids; ``feed`` gives the text that is complete, ``close`` the rest."""

    def __init__(self, tokens: dict[int, bytes]):
        self.tokens = tokens
        self.pending = b""
        self._steps: dict[tuple[bytes, int], tuple[str, bytes]] = {}

    @staticmethod
    def _needs(pending: bytes) -> tuple[int, int, int]:
        """Bytes that an unfinished character still takes, and bounds of the next one; (-1, ..) for a bad lead."""
        for low, high, follow, first, last in _LEAD:
            if low <= pending[0] <= high:
                return follow - len(pending) + 1, first if len(pending) == 1 else 0x80, last if len(pending) == 1 else 0xBF
        return -1, 0, 0

    @classmethod
    def step(cls, pending: bytes, more: bytes) -> tuple[str, bytes]:
        """(text, bytes still pending) after ``more``."""
        text = []
        for value in more:
            if pending:
                need, low, high = cls._needs(pending)
                if low <= value <= high:
                    pending += bytes((value,))
                    if need == 1:
                        text.append(pending.decode())
                        pending = b""
                    continue
                text.append("�")
                pending = b""
            need, _, _ = cls._needs(bytes((value,)))
            if need == 0:
                text.append(chr(value))
            elif need < 0:
                text.append("�")
            else:
                pending = bytes((value,))
        return "".join(text), pending

    def feed(self, ids: Iterable[int]) -> str:
        out, pending, steps, tokens = [], self.pending, self._steps, self.tokens
        for token in ids:
            known = steps.get((pending, token))
            if known is None:
                known = steps[pending, token] = self.step(pending, tokens[token])
            text, pending = known
            out.append(text)
        self.pending = pending
        return "".join(out)

    def close(self) -> str:
        rest, self.pending = ("�" if self.pending else ""), b""
        return rest


class Codec:
    """Encoder and decoder of whole texts with caches.

    The pattern never matches across a single space between two other characters, and such a space begins the
    match that follows. So a text is cut there first, and the ids of a cut are looked up as a whole. A cut of Latin
    letters only is one match with its space.
    """

    def __init__(self, path: str, pattern: str):
        self.vocabulary = Vocabulary.read(path)
        self.transducer = Transducer(self.vocabulary)
        self.pattern = regex.compile(pattern).findall
        self._one_match = _LETTERS if r" ?\p{L}+" in pattern.split("|") else _NOTHING
        self._names = {token: str(token) for token in self.vocabulary.tokens}
        self._pieces: dict[str, str] = {}
        self._cuts: dict[str, str] = {}
        self._aged: dict[str, str] = {}  # cuts met before those
        self.stream = Utf8Stream(self.vocabulary.tokens)
        self._closed: dict[str, str | None] = {}
        for token, value in self.vocabulary.tokens.items():
            text, pending = Utf8Stream.step(b"", value)
            self._closed[str(token)] = text if not pending and text.encode() == value else None

    def encode_texts(self, texts: list[str]) -> list[str]:
        """The ids of each text in decimal, joined by commas."""
        rows, new, parts = [], set(), {}
        cached, aged = self._cuts.get, self._aged.get
        for text in texts:
            plain = not _UNEVEN(text) and not text[:1].isspace() and not text[-1:].isspace()
            cuts = text.split(" ") if plain else _SINGLE_SPACE(text)
            if cuts[0] not in parts:
                parts[cuts[0]] = self.pattern(cuts[0])  # no space before it
            row = list(map(cached, cuts))
            row[0] = None
            lacking = [(k, cuts[k]) for k, ids in enumerate(row) if ids is None]
            for _, cut in lacking[1:]:
                ids = aged(cut)
                if ids is None:
                    new.add(cut)
                else:
                    self._cuts[cut] = ids
            rows.append((row, lacking))
        whole = list(filter(self._one_match, new))
        others = {cut: self.pattern(" " + cut) for cut in new.difference(whole)}
        pieces = list({p for found in (parts, others) for many in found.values() for p in many if p not in self._pieces})
        names = self._names.__getitem__
        ids = [",".join(map(names, x)) for x in self.transducer.encode_all([*((" " + cut).encode() for cut in whole), *map(str.encode, pieces)])]
        self._cuts.update(zip(whole, ids))
        self._pieces.update(zip(pieces, ids[len(whole):]))
        known = self._pieces.__getitem__
        for cut, many in others.items():
            self._cuts[cut] = ",".join(map(known, many))
        out = []
        for row, lacking in rows:
            for k, cut in lacking[1:]:
                row[k] = self._cuts[cut]
            row[0] = ",".join(map(known, parts[lacking[0][1]]))
            out.append(",".join(row))
        for cache, added in ((self._cuts, new), (self._pieces, pieces)):
            for key in added:
                if len(key) > LONG:
                    del cache[key]
        if len(self._cuts) > CACHE_PIECES // 2:
            self._cuts, self._aged = {}, self._cuts
        if len(self._pieces) > CACHE_PIECES // 4:
            self._pieces.clear()
        return out

    def encode_text(self, text: str) -> str:
        return self.encode_texts([text])[0]

    def encode(self, text: str) -> list[int]:
        return self.ids(self.encode_text(text))

    @staticmethod
    def ids(names: str) -> list[int]:
        return list(map(int, names.split(","))) if names else []

    def decode_text(self, ids: str) -> str:
        """The text of ids as ``encode_text`` writes them; the state machine runs where a token is not whole characters."""
        if not ids:
            return ""
        names = ids.split(",")
        parts = list(map(self._closed.__getitem__, names))
        for at in [k for k, part in enumerate(parts) if part is None] if None in parts else ():
            if parts[at] is not None:  # already part of the character before
                continue
            while True:
                parts[at] = self.stream.feed((int(names[at]),))
                at += 1
                if not self.stream.pending:
                    break
                if at == len(parts):
                    parts.append(self.stream.close())
                    break
        return "".join(parts)

    def decode(self, ids: Iterable[int]) -> str:
        return self.decode_text(",".join(map(str, ids)))


_UNEVEN = re.compile(r" \s|\s ").search
_SINGLE_SPACE = re.compile(r"(?<=\S) (?=\S)").split
_LETTERS = re.compile("[A-Za-z\u00AA\u00B5\u00BA\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u024F]+").fullmatch  # all of them letters
_NOTHING = re.compile(r"(?!)").match


_codecs: dict[tuple[str, str], Codec] = K.Cache()


def codec(path: str, pattern: str) -> Codec:
    """This task's codec; its states and caches last as long as the task."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(path, pattern)
    return _codecs[path, pattern]


@contextmanager
def _uncollected() -> Iterator[None]:
    """No search for cycles meanwhile: a run makes none, and each search goes through the states and caches."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


def encode_texts(docs: DataFrame, path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """``docs`` with ``_ids`` (array of int), in place of a column of that name."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col))
            for low, high, _, _ in K.text_slices(texts, RUN_BYTES):
                with _uncollected():
                    ids = pa.array([own.ids(x) for x in own.encode_texts(texts[low:high].fill_null("").to_pylist())], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*batch.slice(low, high - low).columns, ids], [*batch.schema.names, "_ids"])
    docs = docs.drop("_ids")
    return docs.mapInArrow(K.releasing(run, _codecs), _fields(docs, "_ids array<int>"))


def decode_ids(df: DataFrame, path: str, pattern: str, ids_col: str = "_ids") -> DataFrame:
    """``df`` with ``_decoded``, the text of its ids, in place of a column of that name."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index(ids_col))
            for low in range(0, batch.num_rows, 512):
                texts = pa.array([own.decode(x or ()) for x in ids.slice(low, 512).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([*batch.slice(low, 512).columns, texts], [*batch.schema.names, "_decoded"])
    df = df.drop("_decoded")
    return df.mapInArrow(K.releasing(run, _codecs), _fields(df, "_decoded string"))


def digests(docs: DataFrame, path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """The columns of ``docs`` other than the text, and n_tokens, ids_sha256, decoded_sha256 in place of such columns.

    Encodes and decodes as above, but in one pass that keeps no ids.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col))
            counts, encoded, decoded = [], [], []
            for low, high, _, _ in K.text_slices(texts, RUN_BYTES):
                with _uncollected():
                    for ids in own.encode_texts(texts[low:high].fill_null("").to_pylist()):
                        counts.append(ids.count(",") + 1 if ids else 0)
                        encoded.append(hashlib.sha256(ids.encode()).hexdigest())
                        back = own.decode_text(ids)
                        decoded.append(hashlib.sha256(back.encode()).hexdigest())
            columns = {n: c for n, c in zip(batch.schema.names, batch.columns) if n != text_col}
            yield pa.RecordBatch.from_pydict(columns | {
                "n_tokens": pa.array(counts, pa.int64()), "ids_sha256": pa.array(encoded, pa.string()),
                "decoded_sha256": pa.array(decoded, pa.string())})
    docs = docs.drop(*({"n_tokens", "ids_sha256", "decoded_sha256"} - {text_col}))
    return docs.mapInArrow(K.releasing(run, _codecs), _fields(docs.drop(text_col), "n_tokens long, ids_sha256 string, decoded_sha256 string"))


def _fields(df: DataFrame, more: str) -> str:
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), more])


def public_vocabulary() -> tuple[str, str]:
    """(path, pattern) of the vocabulary that the query uses."""
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.col("text"))
    return digests(docs, *public_vocabulary())
