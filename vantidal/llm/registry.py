"""The registered queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from vantidal.llm import bpe, hamming, language_id, media, mixing, near_dedup, pii, quality, token_counts, url_filters

QUERIES = {
    "op1_near_dedup": near_dedup.op1_near_dedup,
    "op2_quality": quality.op2_quality,
    "op3_token_counts": token_counts.op3_token_counts,
    "op4_mixing": mixing.op4_mixing,
    "op5_bpe": bpe.op5_bpe,
    "op6_hamming": hamming.op6_hamming,
    "op7_pii": pii.op7_pii,
    "op8_media": media.op8_media,
    "op9_language_id": language_id.op9_language_id,
    "op10_url_filters": url_filters.op10_url_filters,
}

SQL = {
    "op6_hamming": hamming.SQL,
    "op10_url_filters": url_filters.SQL,
}
