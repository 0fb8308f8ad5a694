"""The registered queries of this package and their SQL twins."""

from __future__ import annotations

from tidyfold.llm import bpe, chat, decontaminate, language, maxscore, mixing, neardup, periodic, scoring, spelling, suffixdedup, tokens, toxicity

QUERIES = {
    "op1_chat_formatting": chat.op1_chat_formatting,
    "op2_token_counts": tokens.op2_token_counts,
    "op3_mixing": mixing.op3_mixing,
    "op4_near_duplicates": neardup.op4_near_duplicates,
    "op5_lm_scoring": scoring.op5_lm_scoring,
    "op6_top_products": maxscore.op6_top_products,
    "op7_language_id": language.op7_language_id,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_decontamination": decontaminate.op9_decontamination,
    "op10_suffix_dedup": suffixdedup.op10_suffix_dedup,
    "op11_spelling_variants": spelling.op11_spelling_variants,
    "op12_bpe_encoding": bpe.op12_bpe_encoding,
    "op13_periodic_runs": periodic.op13_periodic_runs,
}
ORACLES = {
    "op1_chat_formatting": chat.SQL,
    "op3_mixing": mixing.SQL,
    "op4_near_duplicates": neardup.SQL,
    "op6_top_products": maxscore.SQL,
    "op9_decontamination": decontaminate.SQL,
    "op10_suffix_dedup": suffixdedup.SQL,
    "op11_spelling_variants": spelling.SQL,
}
