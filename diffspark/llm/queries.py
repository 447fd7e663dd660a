"""Registered queries of the corpus operators and their SQL."""

from diffspark.llm import (
    exact_dedup,
    fill_middle,
    line_dedup,
    lm_score,
    near_dedup,
    packing,
    quality,
    sharding,
    suffix_dedup,
    token_counts,
    top_k,
    whitening,
    word_bpe,
)

QUERIES = {
    "op1_line_dedup": line_dedup.op1_line_dedup,
    "op2_minhash_near_dedup": near_dedup.op2_minhash_near_dedup,
    "op3_quality_classifier": quality.op3_quality_classifier,
    "op4_sharding": sharding.op4_sharding,
    "op5_exact_top_k": top_k.op5_exact_top_k,
    "op6_packing": packing.op6_packing,
    "op7_lm_score": lm_score.op7_lm_score,
    "op8_token_counts": token_counts.op8_token_counts,
    "op9_bpe": word_bpe.op9_bpe,
    "op10_exact_dedup": exact_dedup.op10_exact_dedup,
    "op11_suffix_dedup": suffix_dedup.op11_suffix_dedup,
    "op12_whitening": whitening.op12_whitening,
    "op13_fill_in_middle": fill_middle.op13_fill_in_middle,
}
ORACLES = {**exact_dedup.SQL, **top_k.SQL, **fill_middle.SQL}
