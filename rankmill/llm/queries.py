"""The registered queries of the numbered operators and their SQL where SQL can express them."""

from __future__ import annotations

from rankmill.llm import byte_pair_queries as byte_pairs
from rankmill.llm import decontamination_queries as decontamination
from rankmill.llm import jaccard_queries as jaccard
from rankmill.llm import language_model_queries as language_model
from rankmill.llm import language_queries as language
from rankmill.llm import native_queries as native
from rankmill.llm import page_queries as pages
from rankmill.llm import phrase_queries as phrases
from rankmill.llm import repetition_queries as repetition
from rankmill.llm import secret_queries as secrets
from rankmill.llm import spelling_queries as spelling
from rankmill.llm import token_queries as tokens

QUERIES = {
    "op1_jaccard_join": jaccard.op1_jaccard_join,
    "op2_mixing": native.op2_mixing,
    "op3_language": language.op3_language,
    "op4_page_text": pages.op4_page_text,
    "op5_secrets": secrets.op5_secrets,
    "op6_token_files": tokens.op6_token_files,
    "op7_language_model": language_model.op7_language_model,
    "op8_url_lists": native.op8_url_lists,
    "op9_decontamination": decontamination.op9_decontamination,
    "op10_quality_rules": repetition.op10_quality_rules,
    "op11_phrases": phrases.op11_phrases,
    "op12_byte_pairs": byte_pairs.op12_byte_pairs,
    "op13_spelling_variants": spelling.op13_spelling_variants,
}

ORACLES = {
    "op1_jaccard_join": jaccard.OP1_SQL,
    "op2_mixing": native.OP2_SQL,
    "op8_url_lists": native.OP8_SQL,
    "op9_decontamination": decontamination.OP9_SQL,
    "op10_quality_rules": repetition.OP10_SQL,
    "op11_phrases": phrases.OP11_SQL,
    "op13_spelling_variants": spelling.OP13_SQL,
}
