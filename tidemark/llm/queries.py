"""The registered queries of this folder and, where SQL can express them, their SQL twins."""

from __future__ import annotations

from . import ann, bpe, langid, minhash, packing, quality, sharding, suffix_dedup, token_counts, url_filter

QUERIES = {
    "op1_bpe": bpe.op1_bpe,
    "op2_token_counts": token_counts.op2_token_counts,
    "op3_packing": packing.op3_packing,
    "op4_url_filter": url_filter.op4_url_filter,
    "op5_quality_rules": quality.op5_quality_rules,
    "op6_suffix_dedup": suffix_dedup.op6_suffix_dedup,
    "op7_nearest": ann.op7_nearest,
    "op8_sharding": sharding.op8_sharding,
    "op9_near_duplicates": minhash.op9_near_duplicates,
    "op10_language_id": langid.op10_language_id,
}

ORACLES = {
    "op4_url_filter": url_filter.OP4_SQL,
    "op5_quality_rules": quality.OP5_SQL,
    "op6_suffix_dedup": suffix_dedup.OP6_SQL,
}
