"""Queries of this subpackage by name, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from . import chat, decontamination, exact_dedup, filter_audit, jaccard_join, lm_scoring, near_dedup, packing, pii, repair, secrets, toxicity, url_filters

QUERIES = {
    "op1_url_filters": url_filters.op1_url_filters,
    "op2_best_fit_packing": packing.op2_best_fit_packing,
    "op3_secret_scans": secrets.op3_secret_scans,
    "op4_lm_scoring": lm_scoring.op4_lm_scoring,
    "op5_exact_dedup": exact_dedup.op5_exact_dedup,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_chat_formatting": chat.op7_chat_formatting,
    "op8_benchmark_decontamination": decontamination.op8_benchmark_decontamination,
    "op9_pii": pii.op9_pii,
    "op10_ngram_jaccard_join": jaccard_join.op10_ngram_jaccard_join,
    "op11_filter_interaction_audit": filter_audit.op11_filter_interaction_audit,
    "op12_conversation_structure_repair": repair.op12_conversation_structure_repair,
    "op13_minhash_near_dedup": near_dedup.op13_minhash_near_dedup,
}

ORACLE_SQL = {
    "op1_url_filters": url_filters.OP1_SQL,
    "op3_secret_scans": secrets.OP3_SQL,
    "op5_exact_dedup": exact_dedup.OP5_SQL,
    "op7_chat_formatting": chat.OP7_SQL,
    "op11_filter_interaction_audit": filter_audit.OP11_SQL,
    "op12_conversation_structure_repair": repair.OP12_SQL,
    "op13_minhash_near_dedup": near_dedup.OP13_SQL,
}
