"""Queries of this subpackage, and SQL where it can say the same."""

from __future__ import annotations

from . import embedding_dedup, exact_dedup, fingerprints, html_text, mixing, near_dedup, packing, quality, repeats, resampling, survivorship, token_counts, toxicity


def queries() -> dict:
    return {
        "op1_minhash_near_dedup": near_dedup.op1_minhash_near_dedup,
        "op2_exact_dedup": exact_dedup.op2_exact_dedup,
        "op3_quality_classifier": quality.op3_quality_classifier,
        "op4_syncmer_fingerprints": fingerprints.op4_syncmer_fingerprints,
        "op5_toxicity": toxicity.op5_toxicity,
        "op6_pfair_mixing": mixing.op6_pfair_mixing,
        "op8_html_extraction": html_text.op8_html_extraction,
        "op7_token_counts": token_counts.op7_token_counts,
        "op9_suffix_array_dedup": repeats.op9_suffix_array_dedup,
        "op10_best_fit_packing": packing.op10_best_fit_packing,
        "op11_golden_records": survivorship.op11_golden_records,
        "op12_embedding_near_dedup": embedding_dedup.op12_embedding_near_dedup,
        "op13_importance_resampling": resampling.op13_importance_resampling,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_exact_dedup": exact_dedup.ORACLE_SQL, "op11_golden_records": survivorship.ORACLE_SQL, "op13_importance_resampling": resampling.ORACLE_SQL}
