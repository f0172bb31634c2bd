"""The queries of this subpackage and their SQL, for the driver's entry module."""

from __future__ import annotations

from . import decontaminate, exact_dedup, filter_audit, hard_negatives, html_text, language, minhash, nearest, packing, quality, sentencepiece, sharding, token_counts


def queries() -> dict:
    return {
        "op1_html_text": html_text.op1_html_text,
        "op10_token_counts": token_counts.op10_token_counts,
        "op11_hard_negatives": hard_negatives.op11_hard_negatives,
        "op12_filter_audit": filter_audit.op12_filter_audit,
        "op13_decontaminate": decontaminate.op13_decontaminate,
        "op2_nearest": nearest.op2_nearest,
        "op3_sentencepiece": sentencepiece.op3_sentencepiece,
        "op4_quality": quality.op4_quality,
        "op5_exact_dedup": exact_dedup.op5_exact_dedup,
        "op6_packing": packing.op6_packing,
        "op7_minhash": minhash.op7_minhash,
        "op8_sharding": sharding.op8_sharding,
        "op9_language": language.op9_language,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_exact_dedup": exact_dedup.SQL, "op11_hard_negatives": hard_negatives.SQL, "op12_filter_audit": filter_audit.SQL, "op13_decontaminate": decontaminate.SQL}
