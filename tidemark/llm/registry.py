"""The queries of the numbered operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from tidemark.llm import (
    block_knn,
    jaccard_join,
    language_id,
    license_scan,
    line_dedup,
    merkle_manifest,
    quality_classifier,
    quality_rules,
    sentencepiece_codec,
    source_mixing,
    suffix_dedup,
    token_alignment,
    token_store,
)


def queries() -> dict[str, Callable]:
    return {
        "op1_jaccard_join": jaccard_join.query,
        "op2_token_store": token_store.query,
        "op3_language_id": language_id.query,
        "op4_suffix_dedup": suffix_dedup.query,
        "op5_quality_rules": quality_rules.query,
        "op6_sentencepiece": sentencepiece_codec.query,
        "op7_quality_classifier": quality_classifier.query,
        "op8_line_dedup": line_dedup.query,
        "op9_source_mixing": source_mixing.query,
        "op10_block_knn": block_knn.query,
        "op11_license_scan": license_scan.query,
        "op12_merkle_manifest": merkle_manifest.query,
        "op13_token_alignment": token_alignment.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_jaccard_join": jaccard_join.SQL,
        "op8_line_dedup": line_dedup.SQL,
        "op9_source_mixing": source_mixing.SQL,
        "op10_block_knn": block_knn.SQL,
        "op12_merkle_manifest": merkle_manifest.SQL,
    }
