"""The queries of the training-data operators and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontamination, jaccard_join, language_id, packing, pii, quality_model, quality_rules, sharding, sql, suffix_dedup, token_counts


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [
        decontamination.op1_spaced_seed_decontamination,
        packing.op2_sum_of_squares_packing,
        pii.op3_skip_chain_pii,
        language_id.op4_hyperdimensional_language_id,
        token_counts.op5_trie_token_counts,
        quality_model.op6_kneser_ney_quality,
        quality_rules.op7_line_first_cleaning,
        jaccard_join.op8_ngram_jaccard_join,
        sharding.op9_virtual_slot_sharding,
        suffix_dedup.op10_suffix_array_dedup,
    ]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_spaced_seed_decontamination": sql.OP1,
        "op5_trie_token_counts": sql.op5(),
        "op7_line_first_cleaning": sql.OP7,
        "op8_ngram_jaccard_join": sql.OP8,
        "op9_virtual_slot_sharding": sql.OP9,
        "op10_suffix_array_dedup": sql.OP10,
    }
