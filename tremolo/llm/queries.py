"""Queries of the training-data operators for the driver: each over its whole table with production parameters."""

from __future__ import annotations

from tremolo.llm import ann, decontam, langid, lines, media, mixing, near, pii, quality, resample, suffix, tokens, turns

QUERIES = {
    "op1_media_chunks": media.op1_media_chunks,
    "op2_pii": pii.op2_pii,
    "op3_decontamination": decontam.op3_decontamination,
    "op4_suffix_dedup": suffix.op4_suffix_dedup,
    "op5_language": langid.op5_language,
    "op6_line_dedup": lines.op6_line_dedup,
    "op7_mixing": mixing.op7_mixing,
    "op8_token_ids": tokens.op8_token_ids,
    "op9_near_duplicates": near.op9_near_duplicates,
    "op10_quality": quality.op10_quality,
    "op11_nearest": ann.op11_nearest,
    "op12_resampling": resample.op12_resampling,
    "op13_conversations": turns.op13_conversations,
}

ORACLES = {
    "op3_decontamination": decontam.ORACLE_SQL,
    "op7_mixing": mixing.ORACLE_SQL,
}
