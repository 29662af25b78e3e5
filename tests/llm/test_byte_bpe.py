import base64
import gc
import pickle
import random

import pyarrow as pa
import pytest
import public_tokenizers
import tiktoken
from brute_llm import HARD, hard_docs, sha
from pyspark import cloudpickle

from flowlake.llm import byte_bpe

PATH, PATTERN = byte_bpe.public_vocabulary()
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def codec():
    return byte_bpe.Codec(PATH, PATTERN)


def test_random_texts_as_the_library(codec, library):
    random.seed(5)
    parts = ["a", "e", "th", "the", "é", "ü", "ß", "日本", "語", " ", "  ", "\n", "\t", "1", "23", "!!", "'s", "'ll", "😀", "\x1c", "\x85", "-"]
    for _ in range(3000):
        text = "".join(random.choice(parts) for _ in range(random.randint(0, 30)))
        ids = codec.encode(text)
        assert ids == library.encode_ordinary(text)
        assert codec.decode(ids) == text


def test_pieces_of_any_length(codec, library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "_FLUSH", 40)
    for text in ("a" * 700, "ab" * 300, "é" * 300, "日本語" * 99, "thethe" * 99, " " * 300 + "x", "antidisestablishment" * 20):
        assert codec.encode(text) == library.encode_ordinary(text)


def test_pairs_fit_as_merging_says(codec):
    v = codec.vocabulary
    random.seed(6)
    for _ in range(4000):
        left, right = random.randrange(len(v.tokens)), random.randrange(len(v.tokens))
        if v.reached(left) and v.reached(right):
            both = [v.tokens[left], v.tokens[right]]
            assert v.fits(left, right) == (v.merged(both[0] + both[1]) == both)


def test_streaming_decoder_replaces_as_python_does():
    random.seed(7)
    for _ in range(3000):
        data = bytes(random.choice(b"a\x80\xbf\xc2\xc3\xe0\xe2\x82\xac\xed\xa0\xf0\x9f\x98\x84\xf4\x90\xff") for _ in range(random.randint(0, 9)))
        stream = byte_bpe.Utf8Stream({k: data[k:k + 1] for k in range(len(data))})
        assert stream.feed(range(len(data))) + stream.close() == data.decode("utf-8", "replace")


def test_unknown_ids_raise(codec):
    with pytest.raises(KeyError):
        codec.decode([10 ** 7])


def test_tables(spark, library):
    found = byte_bpe.digests(hard_docs(spark).select("doc_id", "text", "node"), PATH, PATTERN)
    got = sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256, r.node) for r in found.collect())
    want = []
    for doc_id, text, _ in HARD:
        ids = library.encode_ordinary(text or "")
        want.append((str(doc_id), len(ids), sha(",".join(map(str, ids))), sha(text or ""), "node"))
    assert got == sorted(want)
    encoded = byte_bpe.encode_texts(hard_docs(spark), PATH, PATTERN)
    back = byte_bpe.decode_ids(encoded, PATH, PATTERN)
    assert all(r._decoded == (r.text or "") for r in back.collect())
    assert byte_bpe.digests(hard_docs(spark, []), PATH, PATTERN).count() == 0


def test_query(spark, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in byte_bpe.query(spark, SF).collect():
        ids = library.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(texts[r.doc_id]))


def test_runs_of_texts_with_small_caches(library, monkeypatch):
    random.seed(8)
    monkeypatch.setattr(byte_bpe, "CACHE_PIECES", 60)
    monkeypatch.setattr(byte_bpe, "CACHE_STATES", 150)
    monkeypatch.setattr(byte_bpe, "LONG", 12)
    monkeypatch.setattr(byte_bpe, "_FLUSH", 40)
    own = byte_bpe.Codec(PATH, PATTERN)
    parts = ["th", "the", "ing", "é", "ß", "日本", " ", " ", " ", "  ", "\n", "23", "***", "'s", "😀", "×", "antidisestablishment", "ab" * 90]
    for _ in range(150):
        texts = ["".join(random.choice(parts) for _ in range(random.randint(0, 40))) for _ in range(random.randint(1, 6))]
        assert [own.ids(x) for x in own.encode_texts(texts)] == [library.encode_ordinary(t) for t in texts]


def test_long_cuts_do_not_stay_in_memory():
    own = byte_bpe.Codec(PATH, PATTERN)
    own.encode("the end " + "ab" * 5000 + " " + "é" * 5000 + " 1" + "2" * 5000 + " of it")
    assert max(map(len, [*own._cuts, *own._pieces])) < 100


def test_frequent_cuts_are_encoded_once(monkeypatch):
    monkeypatch.setattr(byte_bpe, "CACHE_PIECES", 20)
    own = byte_bpe.Codec(PATH, PATTERN)
    made = []
    encode_all = own.transducer.encode_all
    monkeypatch.setattr(own.transducer, "encode_all", lambda pieces: made.extend(pieces) or encode_all(pieces))
    for k in range(0, 400, 4):
        own.encode(" ".join(["x", "often", *("ab" * (n % 7 + 1) + chr(97 + n // 26) + chr(97 + n % 26) for n in range(k, k + 4))]))
    assert made.count(b" often") == 1


def test_letters_of_one_match_are_letters():
    letter = byte_bpe.regex.compile(r"\p{L}").fullmatch
    assert all(letter(chr(c)) for c in range(0x250) if byte_bpe._LETTERS(chr(c)))


def test_codecs_end_with_their_tasks(spark, monkeypatch):
    """Functions travel by value, so each task makes a codec; none may wait for the search for cycles."""
    docs = hard_docs(spark)
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, run, fields: run)
    travelling = cloudpickle.dumps(byte_bpe.digests(docs, PATH, PATTERN))
    batch = pa.RecordBatch.from_pydict({"text": ["the end of it"]})

    def alive():
        return sum(type(x).__name__ == "Codec" for x in gc.get_objects())
    gc.disable()
    try:
        before = alive()
        for _ in range(2):
            assert [b.column(0).to_pylist() for b in pickle.loads(travelling)(iter([batch]))] == [[4]]
        assert alive() == before
    finally:
        gc.enable()
