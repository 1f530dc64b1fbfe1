"""The queries of this subpackage, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from . import bpe, decontamination, divergence, hard_negatives, jaccard_join, media, packing, passages, quality, sharding, suffix_dedup, token_counts, toxicity


def queries() -> dict:
    return {
        "op1_toxicity": toxicity.op1_toxicity,
        "op2_quality_rules": quality.op2_quality_rules,
        "op3_jaccard_join": jaccard_join.op3_jaccard_join,
        "op4_bpe": bpe.op4_bpe,
        "op5_token_counts": token_counts.op5_token_counts,
        "op6_media": media.op6_media,
        "op7_sharding": sharding.op7_sharding,
        "op8_suffix_dedup": suffix_dedup.op8_suffix_dedup,
        "op9_passages": passages.op9_passages,
        "op10_packing": packing.op10_packing,
        "op11_hard_negatives": hard_negatives.op11_hard_negatives,
        "op12_divergence": divergence.op12_divergence,
        "op13_decontamination": decontamination.op13_decontamination,
    }


def oracle_sql() -> dict:
    return {
        "op2_quality_rules": quality.oracle_sql(),
        "op3_jaccard_join": jaccard_join.oracle_sql(),
        "op8_suffix_dedup": suffix_dedup.oracle_sql(),
        "op11_hard_negatives": hard_negatives.oracle_sql(),
        "op12_divergence": divergence.oracle_sql(),
        "op13_decontamination": decontamination.oracle_sql(),
    }
