"""The registered queries of this folder and their SQL."""

from __future__ import annotations

from tallyforge.llm import (
    chat_format,
    exact_dedup,
    fill_middle,
    language_id,
    near_dedup,
    packing,
    page_text,
    pieces,
    quality_model,
    quality_rules,
    substring_dedup,
    toxicity,
    turn_repair,
)

QUERIES = {
    "op1_language_id": language_id.op1_language_id,
    "op2_exact_dedup": exact_dedup.op2_exact_dedup,
    "op3_html_extraction": page_text.op3_html_extraction,
    "op4_best_fit_packing": packing.op4_best_fit_packing,
    "op5_quality_rules": quality_rules.op5_quality_rules,
    "op6_chat_formatting": chat_format.op6_chat_formatting,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_sentencepiece": pieces.op8_sentencepiece,
    "op9_suffix_array_dedup": substring_dedup.op9_suffix_array_dedup,
    "op10_minhash_near_dedup": near_dedup.op10_minhash_near_dedup,
    "op11_quality_classifier": quality_model.op11_quality_classifier,
    "op12_fill_in_middle": fill_middle.op12_fill_in_middle,
    "op13_conversation_repair": turn_repair.op13_conversation_repair,
}
ORACLE_SQL = {
    "op2_exact_dedup": exact_dedup.ORACLE,
    "op6_chat_formatting": chat_format.ORACLE,
    "op12_fill_in_middle": fill_middle.ORACLE,
    "op13_conversation_repair": turn_repair.ORACLE,
}
