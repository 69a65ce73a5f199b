"""The queries of the corpus operators, and their SQL where SQL can express them."""

from . import ctw, decontaminate, langid, packing, pii, simhash, substring_dedup, topk_search, toxicity, url_filter

QUERIES = {
    "op1_pii_spans": pii.op1_pii_spans,
    "op2_url_filter": url_filter.op2_url_filter,
    "op3_substring_dedup": substring_dedup.op3_substring_dedup,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_ctw_score": ctw.op5_ctw_score,
    "op6_decontaminate": decontaminate.op6_decontaminate,
    "op7_language_id": langid.op7_language_id,
    "op8_best_fit_packing": packing.op8_best_fit_packing,
    "op9_simhash_groups": simhash.op9_simhash_groups,
    "op10_exact_topk": topk_search.op10_exact_topk,
}
ORACLE_SQL = {
    "op2_url_filter": url_filter.SQL,
    "op3_substring_dedup": substring_dedup.SQL,
    "op6_decontaminate": decontaminate.SQL,
    "op10_exact_topk": topk_search.SQL,
}
