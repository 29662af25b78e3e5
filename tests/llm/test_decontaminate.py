from brute_llm import contamination, documents, hard_docs, item_words, sha

from flowlake.llm import decontaminate

SF = "/root/testdata/sf0.001"
ITEMS = [(1, "quick Brown fox jumps, over the lazy dog near the old"), (2, "gamma delta"), (3, None), (4, "..."), (2, "gamma delta"),
         (30, "epsilon zeta eta theta iota kappa lambda"), (None, "alpha"), (5, "über straße")]


def items(spark, rows=ITEMS):
    return spark.createDataFrame(rows, "item_id long, text string")


def check(rows, bench, found):
    want = [(d[0], n, len(hit), len(ids), tuple(ids), bool(hit)) for d, (n, hit, ids) in zip(rows, contamination(rows, bench))]
    got = [(r.doc_id, r.n_words, r.n_hit, r.n_items, tuple(r["items"]), r.contaminated) for r in found.collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_hard_rows(spark, monkeypatch):
    docs = hard_docs(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    check(rows, ITEMS, decontaminate.contamination(docs, items(spark)))
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 40)  # several passes give the same
    check(rows, ITEMS, decontaminate.contamination(docs, items(spark)))


def test_documents(spark):
    rows = documents(spark, SF)
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = {d[0]: (n, len(hit), sha(",".join(ids))) for d, (n, hit, ids) in zip(rows, contamination(rows, bench))}
    assert {r.doc_id: (r.n_words, r.n_hit, r.items_sha256) for r in decontaminate.query(spark, SF).collect()} == want


def test_removing_documents_and_spans(spark):
    docs = hard_docs(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    hits = contamination(rows, ITEMS)
    clean = decontaminate.clean_documents(docs, items(spark))
    assert clean.columns == docs.columns
    assert clean.count() == sum(not hit for _, hit, _ in hits)
    left = decontaminate.without_spans(docs, items(spark))
    assert left.columns == docs.columns
    want = sorted(str([w for k, w in enumerate(item_words(t)) if k not in hit]) for (_, t), (_, hit, _) in zip(rows, hits))
    assert sorted(str(item_words(r.text)) for r in left.collect()) == want


def test_empty_tables(spark):
    assert decontaminate.contamination(hard_docs(spark, []), items(spark)).count() == 0
    assert decontaminate.contamination(hard_docs(spark), items(spark, [])).filter("contaminated").count() == 0


def test_blocks_are_bounded_and_hold_every_item_once(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 8000)
    rows = [(7, "the same item " * 20)] * 500 + [(k, f"item number {k} " * 20) for k in range(100)] + [(1000, "long " * 4000), (None, None), (1, "")]
    blocks = list(decontaminate._blocks(spark.createDataFrame(rows, "item_id long, text string").repartition(4), "item_id", "text"))
    sizes = [sum(len(r.text) for r in block) for block in blocks]
    assert len(blocks) > 3 and all(size <= 8000 or len(block) == 1 for block, size in zip(blocks, sizes))
    assert sorted((r.item, bytes(r.text).decode()) for block in blocks for r in block) == sorted({r for r in rows if r[1]})
