import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from brute_llm import documents, hard_docs, words
from pyspark.sql import functions as F

from flowlake.llm import tree_weighting as T

SF = "/root/testdata/sf0.001"


def coded(text):
    """(context bytes, nearest first, byte) of every coded byte, by the module's definition."""
    out, before = [], b""
    for word in words(text):
        word = word.replace(b"\0", b"A")  # no lower-cased word has an A
        full = word + b" "
        for k, byte in enumerate(full):
            context = full[:k][::-1]
            if k < T.HEAD:
                context += (b" " + (before[::-1] + b" ")[:T.TAIL]) if before else b""
            else:
                context += b" "
            out.append(((context + bytes(T.DEPTH))[:T.DEPTH], byte))
        before = word
    out.append((((b" " + (before[::-1] + b" ")[:T.TAIL] if before else b"") + bytes(T.DEPTH))[:T.DEPTH], 10))
    return out


class Brute:
    """Context-tree weighting by recursion over dictionaries."""

    def __init__(self, texts):
        self.counts = defaultdict(lambda: [0, 0])
        self.below = defaultdict(set)
        for text in texts:
            for context, byte in coded(text):
                for level in range(8):
                    node = (1 << level) | (byte >> (8 - level))
                    for depth in range(T.DEPTH + 1):
                        self.counts[context[:depth], node][(byte >> (7 - level)) & 1] += 1
                        if depth:
                            self.below[context[:depth - 1], node].add(context[:depth])
        self.memo = {}

    def kt(self, key):
        a, b = self.counts[key]
        return math.lgamma(a + .5) + math.lgamma(b + .5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def weighted(self, context, node):
        key = context, node
        if key not in self.memo:
            value = self.kt(key)
            if len(context) < T.DEPTH:
                value = np.logaddexp(math.log(.5) + value, math.log(.5) + sum(self.weighted(c, node) for c in self.below[key]))
            self.memo[key] = value
        return self.memo[key]

    def log10(self, context, byte):
        total = 0
        for level in range(8):
            node, bit, p = (1 << level) | (byte >> (8 - level)), (byte >> (7 - level)) & 1, None
            for depth in range(T.DEPTH, -1, -1):
                key = context[:depth], node
                if key not in self.counts:
                    continue
                a, b = self.counts[key]
                own = ((b if bit else a) + .5) / (a + b + 1)
                stop = 1 if depth == T.DEPTH else math.exp(math.log(.5) + self.kt(key) - self.weighted(*key))
                p = own if p is None else stop * own + (1 - stop) * p
            total += math.log10(.5 if p is None else p)
        return total


def check(rows, found, held):
    train = [t for d, t, *_ in rows if not held(d)]
    tokens = Counter(w for t in train for w in [*words(t), b"\n"])
    total, distinct = sum(tokens.values()), len(tokens)
    brute = Brute(train)
    memo = {}
    want = []
    for doc_id, text, *_ in rows:
        own = [*words(text), b"\n"]
        score = sum(memo[x] if x in memo else memo.setdefault(x, brute.log10(*x)) for x in coded(text))
        base = sum(math.log10((tokens[w] + .5) / (total + .5 * (distinct + 1))) for w in own)
        want.append((str(doc_id), held(doc_id), len(own), sum(tokens[w] > 0 for w in own), total, base, score))
    got = [(str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in found.collect()]
    assert len(got) == len(want)
    for a, b in zip(sorted(got), sorted(want)):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-9, abs=1e-9)


def test_against_recursion_over_dictionaries(spark):
    rows = [r for r in documents(spark, SF) if len(r[1]) < 900][:60]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    check(rows, T.scores(docs, F.col("doc_id") % 5 == 1), lambda d: d % 5 == 1)


def test_hard_rows(spark):
    docs = hard_docs(spark)
    found = T.scores(docs, F.coalesce(F.col("doc_id") % 5 == 1, F.lit(False)))
    check([(r.doc_id, r.text) for r in docs.collect()], found, lambda d: d is not None and d % 5 == 1)


def test_probabilities_of_a_context_add_up():
    random.seed(12)
    data = [bytes(random.choice(b"abc") for _ in range(random.randint(3, 9))) for _ in range(60)]
    _, key = T.word_grams(pa.array(data, pa.binary()))
    value, n = np.unique(key, return_counts=True)
    split = T._SPLIT
    try:
        T._SPLIT = 0  # one tree with all depths
        tree = T.subtree(value, n)
    finally:
        T._SPLIT = split
    for context in (value >> np.uint64(8))[:10]:
        every = (context << np.uint64(8)) | np.arange(256, dtype=np.uint64)
        assert np.power(10, T.byte_log10(every, tree)).sum() == pytest.approx(1, abs=1e-9)


def test_without_training_rows_and_without_rows(spark):
    rows = T.scores(hard_docs(spark), F.lit(True)).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and r.base_score == 0 for r in rows)
    one = next(r for r in rows if r.doc_id == 6)
    assert one.score == pytest.approx(5 * 8 * math.log10(.5))  # "one", a space, the end
    assert T.scores(hard_docs(spark, []), F.lit(False)).count() == 0


def test_query_holds_out_by_checksum(spark):
    for r in T.query(spark, SF).collect():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 1) and r.score < 0


def test_nul_is_a_byte_like_others(spark):
    rows = [(0, "ab ab ab cd"), (2, "ab \0 x\0y ab"), (1, "\0\0"), (6, "ab"), (11, "\0\0\0\0 \0"), (16, "x\0y")]
    found = T.scores(spark.createDataFrame(rows, "doc_id long, text string"), F.col("doc_id") % 5 == 1)
    check(rows, found, lambda d: d % 5 == 1)
    score = {r.doc_id: r.score for r in found.collect()}
    assert score[1] < score[6]  # an unseen word of two NULs is less likely than a word of training
