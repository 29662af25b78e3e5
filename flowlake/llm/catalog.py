"""The package's registered queries and their comparison SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from flowlake.llm import (
    byte_bpe, compression_quality, decontaminate, exact_dedup, hard_negatives, host_paths, language_id, ngram_join, packing, quotation, tree_weighting,
    url_rules, vector_codes,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quotation_linking": quotation.query,
        "op2_ngram_jaccard_join": ngram_join.query,
        "op3_language_id": language_id.query,
        "op4_benchmark_decontamination": decontaminate.query,
        "op5_url_rules": url_rules.query,
        "op6_token_packing": packing.query,
        "op7_exact_dedup": exact_dedup.query,
        "op8_byte_bpe": byte_bpe.query,
        "op9_host_paths": host_paths.query,
        "op10_tree_weighting": tree_weighting.query,
        "op11_vector_codes": vector_codes.query,
        "op12_hard_negatives": hard_negatives.query,
        "op13_compression_quality": compression_quality.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_quotation_linking": quotation.SQL,
        "op2_ngram_jaccard_join": ngram_join.SQL,
        "op4_benchmark_decontamination": decontaminate.SQL,
        "op7_exact_dedup": exact_dedup.SQL,
        "op11_vector_codes": vector_codes.SQL,
        "op12_hard_negatives": hard_negatives.SQL,
    }
