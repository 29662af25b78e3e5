"""A corpus pipeline of five stages over ``documents``; each works on all that the one before kept.

Language identification drops texts without letters and texts of which no language has three fifths of the letters:
mixtures go, however many languages there are. It does not judge digits or token junk beside the letters.
Exact deduplication keeps the smallest doc_id of equal texts. The n-gram join (five words, similarity 0.8) keeps
the row with the smallest doc_id of each connected group; rows are told apart by doc_id and a 64-bit hash of the text. Decontamination drops documents with a benchmark window. The last
stage encodes and decodes the rest and returns doc_id, lang, source, n_tokens and digests of ids and text.

All stages but the last return the columns of documents. Edge cases are those of the operators: null and empty
texts go in the first stage, near copies without doc_id go if another of their group has one, an empty table passes through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlake.llm import byte_bpe, decontaminate, exact_dedup, language_id, ngram_join
from flowlake.llm.routing import numbered
from flowlake.session import cut_lineage, drop_scratch, temporary_tables

#: Least share of a text's letters that its language must have: a clear majority, so that an even mixture of two languages
#: fails as well, whose larger half has a little over one half.
LANGUAGE_SHARE = 0.6
NEAR_DUPLICATES = ngram_join.Rule(width=5, num=80, den=100)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    plain, name = numbered(docs)
    found = language_id.predict(plain, language_id.fit(docs), name["text"])
    return found.filter((F.col("_lang") != "und") & (F.col("_score") >= LANGUAGE_SHARE)).select(plain.columns).toDF(*docs.columns)


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.distinct_documents(docs)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.without_near_copies(docs, NEAR_DUPLICATES)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return byte_bpe.digests(docs.select("doc_id", "text", "lang", "source"), *byte_bpe.public_vocabulary())


STAGES = [
    ("language_id", known_language),
    ("exact_dedup", distinct_texts),
    ("ngram_jaccard_join", one_of_each_group),
    ("benchmark_decontamination", without_benchmark),
    ("byte_bpe", encoded),
]

#: SQL cannot express the language model and the encoder; the tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages. Once a stage's rows are written, its other tables and the rows before it are deleted."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        with temporary_tables(spark):
            docs = cut_lineage(stage(spark, docs, sf_dir), name, outlives=True)
        if before is not None:
            drop_scratch(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
