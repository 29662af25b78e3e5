import itertools
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pyarrow.compute
from brute_llm import hard_docs

from flowlake.llm import kernels as K
from flowlake.llm import language_id

SF = "/root/testdata/sf0.01"


def path_cost(scores, path, switch):
    return sum(scores[t][k] for t, k in enumerate(path)) - switch * sum(a != b for a, b in zip(path, path[1:]))


def test_viterbi_against_all_paths():
    random.seed(8)
    for _ in range(200):
        scores = np.array([[random.uniform(-5, 0) for _ in range(3)] for _ in range(random.randint(1, 6))])
        best = max(path_cost(scores, p, 2.5) for p in itertools.product(range(3), repeat=len(scores)))
        assert abs(path_cost(scores, language_id.viterbi(scores, 2.5), 2.5) - best) < 1e-9


def test_texts_of_one_language_need_no_path(spark):
    """Skipping the path where no run speaks for another language changes no label."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("text", "lang").limit(300)
    model = language_id.fit(docs)
    texts = [r.text for r in docs.collect()]
    for _, _, data, offsets in K.text_slices(pa.array(texts, pa.string())):
        found = language_id.letter_words(data, offsets)
        label = language_id.label_words(model, found)
        scores = np.add.reduceat(model.weights[found.bucket], found.first, axis=0).astype(float)
        candidates = model.candidates[found.script]
        scores[~candidates] = language_id._NOT_A_CANDIDATE * np.repeat(found.size, (~candidates).sum(1))
        scores[~candidates.any(1)] = 0
        for row in np.unique(found.row)[:40]:
            own = found.row == row
            path = language_id.viterbi(scores[own], language_id.SWITCH)
            assert abs(path_cost(scores[own], path, language_id.SWITCH) - path_cost(scores[own], label[own], language_id.SWITCH)) < 1e-6


def test_held_out_accuracy(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    found = [r for r in language_id.query(spark, SF).collect() if r.held_out]
    assert len(found) > 150 and all(0 <= r.score <= 1 for r in found)
    assert sum(truth[r.doc_id] == r.lang_pred for r in found) / len(found) >= 0.98


def test_letters_words_and_scripts():
    data = "Ab1é 日本! ж".encode()
    found = language_id.letter_words(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
    assert found.start.tolist() == [0, 3, 5, 9] and found.size.tolist() == [2, 1, 2, 1]
    assert [language_id.SCRIPTS[k] for k in found.script] == ["latin", "latin", "han", "cyrillic"]


def test_mixed_scripts_hard_rows_and_empty_tables(spark):
    train = spark.createDataFrame([("the cat and the dog are here with us " * 20, "en"), ("der hund und die katze sind nicht hier " * 20, "de"),
                                   ("кошка и собака здесь вместе с нами " * 20, "ru"), ("unlabelled", None), (None, "en")], "text string, lang string")
    model = language_id.fit(train)
    assert model.languages == ["de", "en", "ru"]
    text = "the dog and the cat are here " * 4 + "кошка и собака здесь " * 3
    row = language_id.predict(spark.createDataFrame([(text,)], "text string"), model, with_spans=True).first()
    assert [s.lang for s in row._lang_spans] == ["en", "ru"] and row._lang == "en"
    assert text[row._lang_spans[1].first:].startswith("кошка")
    rows = language_id.predict(hard_docs(spark), model).collect()
    for r in rows:
        letters = any(c.isalpha() for c in r.text or "")
        assert (r._lang == "und") == (not letters) and (r._score > 0) == letters
    assert [r.node for r in rows] == ["node"] * len(rows)
    assert language_id.predict(hard_docs(spark, []), model).count() == 0
    nothing = language_id.fit(train.filter("false"))
    assert {r._lang for r in language_id.predict(hard_docs(spark), nothing).collect()} == {"und"}


def test_memory_does_not_follow_the_batch():
    language_id.letter_words(np.frombuffer(b"one", np.uint8), np.array([0, 3]))
    batch = pa.RecordBatch.from_pydict({"lang": ["en"] * 2000, "text": ["the cat and the dog are here with us " * 50] * 2000})
    tracemalloc.start()
    try:
        counted = list(language_id._count(iter([batch])))
        assert tracemalloc.get_traced_memory()[1] < 64 << 20
    finally:
        tracemalloc.stop()
    letters = sum(b.column(2).filter(pa.compute.less(b.column(1), language_id.BUCKETS)).to_numpy().sum() for b in counted)
    assert letters == 2000 * 50 * 28
