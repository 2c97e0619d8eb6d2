"""Queries and SQL of the corpus operators, for ``__spark_entry__``."""

from __future__ import annotations

from . import media, mix_sources, near_dedup, pack, phrase_dedup, quality, run_length_dedup, token_files, topk, toxicity

QUERIES = {
    "op1_mix_sources": mix_sources.op1_mix_sources,
    "op2_token_files": token_files.op2_token_files,
    "op3_best_fit_packing": pack.op3_best_fit_packing,
    "op4_attention_quality": quality.op4_attention_quality,
    "op5_matroska": media.op5_matroska,
    "op6_factorization_toxicity": toxicity.op6_factorization_toxicity,
    "op7_phrase_automata": phrase_dedup.op7_phrase_automata,
    "op8_hyperminhash": near_dedup.op8_hyperminhash,
    "op9_exact_top_k": topk.op9_exact_top_k,
    "op10_run_length_index": run_length_dedup.op10_run_length_index,
}

ORACLE_SQL = {
    "op1_mix_sources": mix_sources.ORACLE,
    "op7_phrase_automata": phrase_dedup.ORACLE,
    "op8_hyperminhash": near_dedup.ORACLE,
    "op9_exact_top_k": topk.ORACLE,
    "op10_run_length_index": run_length_dedup.ORACLE,
}
