"""Queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from . import bpe, byte_dedup, decontaminate, fingerprints, fixity, language, near_dedup, quality, token_counts, word_dedup

QUERIES = {
    "op1_token_counts": token_counts.query,
    "op2_near_duplicates": near_dedup.query,
    "op3_fixity_audit": fixity.query,
    "op4_fingerprints": fingerprints.query,
    "op5_suffix_dedup": byte_dedup.query,
    "op6_quality": quality.query,
    "op7_decontamination": decontaminate.query,
    "op8_bpe": bpe.query,
    "op9_language": language.query,
    "op10_substring_dedup": word_dedup.query,
    "pages_language": language.pages_query,
    "proximity_matches": decontaminate.proximity_query,
}
ORACLES = {
    "op3_fixity_audit": fixity.ORACLE,
    "op7_decontamination": decontaminate.ORACLE,
    "op10_substring_dedup": word_dedup.ORACLE,
    "proximity_matches": decontaminate.NEAR_ORACLE,
}
