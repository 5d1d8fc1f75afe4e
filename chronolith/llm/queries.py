"""The queries of this subpackage, one for each operator, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, embedding_dedup, exact_dedup, language_id, merkle, ngram_join, packing, pii, substring_dedup, suffix_dedup, toxicity, vector_codes


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_exact_dedup": exact_dedup.op1_exact_dedup,
        "op2_ngram_join": ngram_join.op2_ngram_join,
        "op3_substring_dedup": substring_dedup.op3_substring_dedup,
        "op4_toxicity": toxicity.op4_toxicity,
        "op5_packing": packing.op5_packing,
        "op6_embedding_dedup": embedding_dedup.op6_embedding_dedup,
        "op7_pii": pii.op7_pii,
        "op8_bpe": bpe.op8_bpe,
        "op9_language_id": language_id.op9_language_id,
        "op10_chat": chat.op10_chat,
        "op11_suffix_dedup": suffix_dedup.op11_suffix_dedup,
        "op12_vector_codes": vector_codes.op12_vector_codes,
        "op13_merkle": merkle.op13_merkle,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": exact_dedup.SQL, "op3_substring_dedup": substring_dedup.SQL, "op11_suffix_dedup": suffix_dedup.SQL, "op12_vector_codes": vector_codes.SQL, "op13_merkle": merkle.SQL}
