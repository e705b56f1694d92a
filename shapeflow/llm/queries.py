"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import chat_format, decontamination, language_id, lm_scoring, minhash_dedup, mixing, quality_classifier, quality_rules, substring_dedup, suffix_dedup


def queries() -> dict:
    return {
        "op1_mixing": mixing.op1,
        "op2_lm_scoring": lm_scoring.op2,
        "op3_language_id": language_id.op3,
        "op4_quality_classifier": quality_classifier.op4,
        "op5_suffix_dedup": suffix_dedup.op5,
        "op6_minhash_dedup": minhash_dedup.op6,
        "op7_chat_format": chat_format.op7,
        "op10_substring_dedup": substring_dedup.op10,
        "op9_decontamination": decontamination.op9,
        "op8_quality_rules": quality_rules.op8,
    }


def oracle_sql() -> dict[str, str]:
    return {"op9_decontamination": decontamination.ORACLE, "op6_minhash_dedup": minhash_dedup.ORACLE, "op7_chat_format": chat_format.ORACLE, "op8_quality_rules": quality_rules.ORACLE}
