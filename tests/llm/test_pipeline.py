from pathlib import Path

import corpus_pipeline
from brute_llm import contamination, hard_docs, normalised, roots, sha, similar
from pyspark.sql import functions as F

from flowlake.llm import language_id
from flowlake.session import scratch_path

SF = "/root/testdata/sf0.001"


def kept_after(rows, items):
    """Doc ids that the stages between language and encoding keep, by brute force."""
    first = {}
    for doc_id, text in sorted(rows):
        first.setdefault(normalised(text), (doc_id, text))
    rows = sorted(first.values())
    rule = corpus_pipeline.NEAR_DUPLICATES
    near = similar(rows, rule.width, rule.num, rule.den)
    root = roots(range(len(rows)), [(k, o) for k, (_, links) in enumerate(near) for o in links])
    rows = [r for k, r in enumerate(rows) if root[k] == k]
    return {d for (d, _), (_, hit, _) in zip(rows, contamination(rows, items)) if not hit}


def test_five_stages_of_the_documents(spark):
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "language_id", "exact_dedup", "ngram_jaccard_join", "benchmark_decontamination", "byte_bpe"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    spoken = corpus_pipeline.known_language(spark, docs, SF)
    assert spoken.columns == docs.columns and spoken.count() == len(texts)  # all have letters of one language
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    found = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in found} == kept_after(list(texts.items()), items)
    assert all(r.decoded_sha256 == sha(texts[r.doc_id]) and r.n_tokens > 0 for r in found)


def test_one_copy_of_the_documents_at_a_time(spark, monkeypatch):
    """Each stage finds the rows of the one before and nothing else that was written; the last stage's rows are left."""
    folder = Path(scratch_path(spark, "x")).parent
    before = set(folder.iterdir()) if folder.exists() else set()
    seen = []

    def watched(stage):
        def run(*args):
            seen.append([p.name.rsplit("-", 1)[0] for p in set(folder.iterdir()) - before] if folder.exists() else [])
            return stage(*args)
        return run

    monkeypatch.setattr(corpus_pipeline, "STAGES", [(name, watched(stage)) for name, stage in corpus_pipeline.STAGES])
    corpus_pipeline.run(spark, SF).count()
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert seen == [[], *([name] for name in names[:-1])]


def test_hard_rows_and_empty_table_pass_through(spark):
    docs = hard_docs(spark)
    for rows in (docs, docs.filter("false")):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            columns = rows.columns
            rows = stage(spark, rows.withColumn("source", rows["node"]) if "source" not in columns else rows, SF)
        assert set(docs.columns) <= set(rows.columns)
        last = corpus_pipeline.STAGES[-1][1](spark, rows, SF)
        last.count()


def test_language_stage_drops_even_mixtures(spark):
    """Even mixtures of two, three and four languages go; held-out labelled texts stay."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    long = {lang: next(r.text for r in docs.orderBy("doc_id").collect() if r.lang == lang and len(r.text) > 1500) for lang in ("de", "en", "es", "fr")}

    def letters(lang, n):
        """The first words of a long text up to n letters."""
        text = long[lang]
        ends = [k for k in range(len(text)) if text[k].isspace() and sum(c.isalpha() for c in text[:k]) <= n]
        return text[:ends[-1]]

    mixed = [" ".join(letters(lang, 400) for lang in langs) for langs in (("de", "en"), ("fr", "es"), ("en", "fr", "de"), ("es", "de", "fr", "en"))]
    rows = docs.unionByName(spark.createDataFrame([(-k, text, None) for k, text in enumerate(mixed, 1)], docs.schema))
    kept = {r.doc_id for r in corpus_pipeline.known_language(spark, rows, SF).collect()}
    assert not {d for d in kept if d < 0} and len(kept) == docs.count()
    larger = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    held_out = language_id.remainder("doc_id", 4) == 2
    found = language_id.predict(larger.filter(held_out), language_id.fit(larger.filter(~held_out)))
    stay = found.agg(F.avg((F.col("_score") >= corpus_pipeline.LANGUAGE_SHARE).cast("double"))).first()[0]
    assert stay >= 0.99


def test_near_duplicates_go_by_row(spark):
    """A repeated doc_id neither takes an unrelated text with it nor saves a near copy; near copies without an id go."""
    near = [" ".join(f"{x}{k}" for k in range(60)) + f" end {n}" for n, x in enumerate("aaa")] + [" ".join(f"b{k}" for k in range(60)) + f" end {n}" for n in range(2)]
    rows = [(1, near[0]), (2, near[1]), (2, "a clean text with no copy under the same id"), (None, near[2]), (5, near[3]), (5, near[4]), (None, "no id and no copy")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(((r.doc_id or 0, r.text) for r in corpus_pipeline.one_of_each_group(spark, docs, SF).collect()))
    assert [r for r in kept if r[0] != 5] == [(0, "no id and no copy"), (1, near[0]), (2, rows[2][1])]
    assert [d for d, _ in kept].count(5) == 1
