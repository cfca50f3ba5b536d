"""Queries of this subpackage and the SQL they are held against."""

from __future__ import annotations

from . import audio, language_id, line_dedup, mixing, near_dedup, piece_codec, quality, quality_rules, sharding, substring_dedup


def queries() -> dict:
    return {
        "op1_substring_dedup": substring_dedup.query,
        "op2_mix": mixing.query,
        "op3_hilbert_shards": sharding.query,
        "op4_minhash_near_dedup": near_dedup.query,
        "op5_line_dedup": line_dedup.query,
        "op6_audio_features": audio.query,
        "op7_quality_classifier": quality.query,
        "op8_language_id": language_id.query,
        "op9_sentencepiece": piece_codec.query,
        "op10_llr_quality_rules": quality_rules.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_mix": mixing.ORACLE,
        "op5_line_dedup": line_dedup.ORACLE,
    }
