"""The training-data queries and, where SQL can express them, their oracles."""

from __future__ import annotations

from tidemark.llm import op1_jaccard_join, op10_pii, op11_hard_negatives, op12_spelling, op13_language_id, op2_substring_dedup, op3_quality_rules, op4_sentencepiece, op5_quality_classifier, op6_topk, op7_mixing, op8_line_dedup, op9_sharding

QUERIES = {
    "op1_jaccard_join": op1_jaccard_join.op1_jaccard_join,
    "op2_substring_dedup": op2_substring_dedup.op2_substring_dedup,
    "op3_quality_rules": op3_quality_rules.op3_quality_rules,
    "op4_sentencepiece": op4_sentencepiece.op4_sentencepiece,
    "op5_quality_classifier": op5_quality_classifier.op5_quality_classifier,
    "op6_topk": op6_topk.op6_topk,
    "op7_mixing": op7_mixing.op7_mixing,
    "op8_line_dedup": op8_line_dedup.op8_line_dedup,
    "op9_sharding": op9_sharding.op9_sharding,
    "op10_pii": op10_pii.op10_pii,
    "op11_hard_negatives": op11_hard_negatives.op11_hard_negatives,
    "op12_spelling": op12_spelling.op12_spelling,
    "op13_language_id": op13_language_id.op13_language_id,
}

ORACLES = {
    "op1_jaccard_join": op1_jaccard_join.SQL,
    "op2_substring_dedup": op2_substring_dedup.SQL,
    "op6_topk": op6_topk.SQL,
    "op11_hard_negatives": op11_hard_negatives.SQL,
    "op8_line_dedup": op8_line_dedup.SQL,
}
