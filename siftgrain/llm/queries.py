"""The queries of the operators of this package, by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from siftgrain.llm import decontaminate, embedding_dedup, jaccard_join, katz, language_id, licenses, quality, sentencepiece, suffix_dedup, token_counts


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_sentencepiece": sentencepiece.query,
        "op2_decontaminate": decontaminate.query,
        "op3_embedding_dedup": embedding_dedup.query,
        "op4_katz_scores": katz.query,
        "op5_license_scan": licenses.query,
        "op6_suffix_dedup": suffix_dedup.query,
        "op7_language_id": language_id.query,
        "op8_jaccard_join": jaccard_join.query,
        "op9_quality": quality.query,
        "op10_token_counts": token_counts.query,
    }


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL where it can express the operator."""
    return {"op2_decontaminate": decontaminate.SQL, "op3_embedding_dedup": embedding_dedup.SQL, "op6_suffix_dedup": suffix_dedup.SQL, "op8_jaccard_join": jaccard_join.SQL}
