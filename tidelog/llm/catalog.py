"""The queries of this package and their SQL."""

from tidelog.llm import ann, bpe, exact_dedup, jaccard, language_id, mixing, quality, substring_dedup, toxicity, url_filter

QUERIES = {
    "op1_exact_dedup": exact_dedup.op1_exact_dedup,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_url_filter": url_filter.op3_url_filter,
    "op4_mix_sources": mixing.op4_mix_sources,
    "op5_nearest": ann.op5_nearest,
    "op6_substring_dedup": substring_dedup.op6_substring_dedup,
    "op7_bpe": bpe.op7_bpe,
    "op8_language_id": language_id.op8_language_id,
    "op9_jaccard": jaccard.op9_jaccard,
    "op10_quality": quality.op10_quality,
}
ORACLES = {"op1_exact_dedup": exact_dedup.SQL, "op3_url_filter": url_filter.SQL, "op4_mix_sources": mixing.SQL, "op6_substring_dedup": substring_dedup.SQL, "op9_jaccard": jaccard.SQL}
