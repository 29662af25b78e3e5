import random

import numpy as np
import pyarrow as pa
from brute_llm import LOWER, WORD
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark import cloudpickle

from flowlake.llm import byte_bpe, decontaminate, language_id, ngram_join
from flowlake.llm import kernels as K
from flowlake.llm.components import components
from flowlake.llm.routing import without_ids


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aAbB é日\t\n ", max_size=20)), min_size=1, max_size=8))
def test_words_are_those_of_the_pattern(texts):
    got, seen = [], {}
    for low, high, data, offsets in K.text_slices(pa.array(texts, pa.string()), 8):
        found = K.words(data, offsets, K.NOT_SPACE)
        for row, a, b, value in zip(found.row, found.start, found.end, found.hash):
            word = data[a:b].tobytes().translate(LOWER)
            got.append((low + int(row), word))
            assert seen.setdefault(word, int(value)) == int(value)
    assert got == [(k, w) for k, t in enumerate(texts) for w in WORD.findall((t or "").encode().translate(LOWER))]
    assert len(set(seen.values())) == len(seen)


def test_slices_of_sliced_arrays_and_windows():
    column = pa.array(["skip", "a b", "", "c d e", None]).slice(1)
    rows = [(low, high, data.tobytes()) for low, high, data, _ in K.text_slices(column, 3)]
    assert b"".join(r[2] for r in rows) == b"a bc d e" and rows[-1][1] == 4
    assert len(K.windows(np.arange(2, dtype=np.uint64), 3)) == 0
    assert len(set(K.windows(np.array([1, 2, 1, 2, 1], np.uint64), 2).tolist())) == 2


def test_components_against_union_find(spark):
    random.seed(4)
    edges = [(random.randint(0, 60), random.randint(0, 60)) for _ in range(35)] + [(k + 1, k) for k in range(100, 140)] + [(7, 7), (None, 3)]
    parent = {x: x for e in edges[:-1] for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges[:-1]:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    linked = {x for a, b in edges[:-1] if a != b for x in (a, b)}
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for x in linked}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_rows_without_the_dropped_ids_stay(spark):
    table = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c"), (2, "d"), (3, "e")], "doc_id long, _hash string")
    dropped = spark.createDataFrame([(2,), (9,)], "doc_id long")
    assert sorted(r[1] for r in without_ids(table, "doc_id", dropped).collect()) == ["a", "c", "e"]


def test_task_functions_travel_without_what_the_driver_has_worked_out():
    K.powers("up", 10), K.powers("down", 10)
    language_id.letter_words(np.frombuffer(b"one two", np.uint8), np.array([0, 7]))
    byte_bpe.codec(*byte_bpe.public_vocabulary())
    for function in (ngram_join._count(ngram_join.Rule()), language_id._count, decontaminate._scan(None, "text", False), byte_bpe.codec):
        assert len(cloudpickle.dumps(function)) < 200_000
