"""The queries of the training-data operators."""

from __future__ import annotations

from . import decontaminate, filter_audit, html_text, jaccard_join, language_id, lm_score, phrases, piece_bpe, quality_rules, source_mix, substring_dedup, suffix_dedup, toxicity

_OPERATORS = {
    "op1_ngram_jaccard_join": jaccard_join,
    "op2_suffix_array_dedup": suffix_dedup,
    "op3_sentencepiece": piece_bpe,
    "op4_substring_dedup": substring_dedup,
    "op5_html_extraction": html_text,
    "op6_language_id": language_id,
    "op7_toxicity": toxicity,
    "op8_quality_rules": quality_rules,
    "op9_lm_score": lm_score,
    "op10_decontamination": decontaminate,
    "op11_source_mix": source_mix,
    "op12_filter_audit": filter_audit,
    "op13_phrase_collocations": phrases,
}
QUERIES = {**{name: m.query for name, m in _OPERATORS.items()}, "lm_base_score": lm_score.base_query, "mix_targets": source_mix.targets_query}
ORACLES = {**{name: m.ORACLE for name, m in _OPERATORS.items() if getattr(m, "ORACLE", None)}, "lm_base_score": lm_score.BASE_ORACLE, "mix_targets": source_mix.TARGETS_ORACLE}
