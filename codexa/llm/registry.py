"""The queries of the ten operators and the SQL of those that SQL can express."""

from __future__ import annotations

from codexa.llm import bpe_codec, exact_dedup, fingerprints, license_scan, line_dedup, lm_scores, near_dedup, packing, quality, url_filter


def queries():
    return {
        "op1_fingerprints": fingerprints.query,
        "op2_bpe_codec": bpe_codec.query,
        "op3_line_dedup": line_dedup.query,
        "op4_url_filter": url_filter.query,
        "op5_exact_dedup": exact_dedup.query,
        "op6_lm_scores": lm_scores.query,
        "op7_license_scan": license_scan.query,
        "op8_best_fit_packing": packing.query,
        "op9_near_dedup": near_dedup.query,
        "op10_quality": quality.query,
    }


def oracles():
    return {"op4_url_filter": url_filter.ORACLE, "op5_exact_dedup": exact_dedup.ORACLE}
