import random

import numpy as np
import pyarrow as pa
from brute_llm import hard_docs

from flowlake.llm import packing

SF = "/root/testdata/sf0.001"


def test_best_fit_decreasing_against_search():
    random.seed(13)
    for capacity in (1, 7, 64, 100):
        for _ in range(150):
            lengths = [random.randint(1, capacity) for _ in range(random.randint(0, 50))]
            rooms = []
            for k in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
                fits = [r for r in range(len(rooms)) if rooms[r] >= lengths[k]]
                if fits:
                    rooms[min(fits, key=lambda r: rooms[r])] -= lengths[k]
                else:
                    rooms.append(capacity - lengths[k])
            rows = packing.best_fit_decreasing(lengths, capacity)
            assert sorted(k for row in rows for k in row) == list(range(len(lengths)))
            assert sorted(capacity - sum(lengths[k] for k in row) for row in rows) == sorted(rooms)


def byte_encoder():
    return lambda text: list(text.encode())


def check_rows(rows, capacity):
    parts = {}
    for r in rows:
        ids, positions = np.frombuffer(r["ids"], "<i4"), np.frombuffer(r["positions"], "<i4")
        ends = r["cu_seqlens"]
        assert len(ids) == len(positions) == capacity and ends[0] == 0 and ends[-1] == r["n_ids"] <= capacity
        assert (ids[ends[-1]:] == 256).all()
        for doc, part, first, a, b in zip(r["doc_ids"], r["parts"], r["firsts"], ends, ends[1:]):
            assert positions[a:b].tolist() == list(range(b - a)) and first == part * capacity
            parts.setdefault((doc, part), []).append(ids[a:b].tolist())
    return parts


def test_buffers_lose_nothing(monkeypatch):
    monkeypatch.setattr(packing, "BUFFER_IDS", 500)
    random.seed(14)
    texts = ["x" * random.randint(0, 60) for _ in range(300)] + ["y" * 1000]
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(301)), "text": pa.array(texts)})
    rows = [r for b in packing._pack(byte_encoder, 256, 64)(iter([batch])) for r in b.to_pylist()]
    parts = check_rows(rows, 64)
    assert all(len(v) == 1 for v in parts.values())
    for doc, text in enumerate(texts):
        whole = [x for part in range(len(text) // 64 + 1) for x in parts.get((doc, part), [[]])[0]]
        assert whole == [*text.encode(), 256]
    assert sum(r["n_ids"] for r in rows) / (64 * len(rows)) > 0.9


def test_hard_rows_and_empty_table(spark):
    def encoder():  # goes to the workers by value
        return lambda text: list(text.encode())

    docs = hard_docs(spark)
    rows = [r.asDict() for r in packing.packed_rows(docs, encoder, 256, 128).collect()]
    parts = check_rows(rows, 128)
    got = sorted((str(doc), len(x)) for (doc, _), pieces in parts.items() for x in pieces)
    want = []
    for r in docs.collect():
        n = len((r.text or "").encode()) + 1
        want += [(str(r.doc_id), min(128, n - a)) for a in range(0, n, 128)]
    assert got == sorted(want)
    assert packing.packed_rows(hard_docs(spark, []), encoder, 256).count() == 0


def test_documents_come_back(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    packing.write_matrices(packing.packed_rows(docs, packing.public_encoder, packing.END_ID), str(tmp_path / "rows"))
    rows = spark.read.parquet(str(tmp_path / "rows"))
    encode = packing.public_encoder()
    texts = {r.doc_id: r.text for r in docs.collect()}
    back = {r.doc_id: np.frombuffer(r.ids, "<i4").tolist() for r in packing.unpacked(rows).collect()}
    assert back == {k: [*encode(t), packing.END_ID] for k, t in texts.items()}
    total = rows.agg({"n_ids": "sum"}).first()[0]
    assert total / (rows.count() * packing.ROW_IDS) > 0.95


def test_at_most_half_a_buffer_waits(monkeypatch):
    """Texts of two thirds of a row fill no row: each packing still hands on half a buffer and more."""
    monkeypatch.setattr(packing, "BUFFER_IDS", 6400)
    monkeypatch.setattr(packing.K, "partition", lambda: 0)
    packings = []
    pack = packing.best_fit_decreasing
    monkeypatch.setattr(packing, "best_fit_decreasing", lambda sizes, capacity: packings.append(len(sizes)) or pack(sizes, capacity))
    texts = [chr(97 + k % 26) * 42 for k in range(2000)]
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(2000)), "text": pa.array(texts)})
    rows = [r for b in packing._pack(lambda: lambda text: list(text.encode()), 0, 64)(iter([batch])) for r in b.to_pylist()]
    assert sorted(d for r in rows for d in r["doc_ids"]) == list(range(2000))
    assert sum(packings) < 3 * 2000
