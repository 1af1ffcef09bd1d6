"""The queries of this subpackage, and SQL for those that SQL can express."""

from sparkatlas.llm import bpe, decontaminate, jaccard_join, language_id, line_dedup, lm_scoring, secrets, substring_dedup, token_counts, topk

QUERIES = {
    "op1_ngram_jaccard": jaccard_join.query,
    "op2_token_counts": token_counts.query,
    "op3_exact_topk": topk.query,
    "op4_byte_bpe": bpe.query,
    "op5_line_dedup": line_dedup.query,
    "op6_secret_scan": secrets.query,
    "op7_substring_dedup": substring_dedup.query,
    "op8_lm_scoring": lm_scoring.query,
    "op9_decontaminate": decontaminate.query,
    "op10_language_id": language_id.query,
}
SQL = {"op7_substring_dedup": substring_dedup.SQL, "op1_ngram_jaccard": jaccard_join.SQL, "op3_exact_topk": topk.SQL, "op5_line_dedup": line_dedup.SQL, "op9_decontaminate": decontaminate.SQL}
