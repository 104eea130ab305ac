"""The queries of this subpackage, by name, and SQL for those that SQL can express."""

from __future__ import annotations

from corroba.llm.ctw import op4_lm_scores
from corroba.llm.decontaminate import OP1_SQL, op1_decontamination
from corroba.llm.langid import op2_language_id
from corroba.llm.minhash import op3_near_duplicates
from corroba.llm.packing import op5_packing
from corroba.llm.phrases import OP13_SQL, op13_phrases
from corroba.llm.quality import op11_quality
from corroba.llm.rans import op8_token_ids
from corroba.llm.resampling import OP12_SQL, op12_importance_resampling
from corroba.llm.secrets import op9_secrets
from corroba.llm.token_counts import op7_token_counts
from corroba.llm.vectors import OP10_SQL, op10_vector_duplicates
from corroba.llm.wrappers import op6_main_text

QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_language_id": op2_language_id,
    "op3_near_duplicates": op3_near_duplicates,
    "op4_lm_scores": op4_lm_scores,
    "op5_packing": op5_packing,
    "op6_main_text": op6_main_text,
    "op7_token_counts": op7_token_counts,
    "op8_token_ids": op8_token_ids,
    "op9_secrets": op9_secrets,
    "op10_vector_duplicates": op10_vector_duplicates,
    "op11_quality": op11_quality,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_phrases": op13_phrases,
}

ORACLE_SQL: dict[str, str] = {
    "op1_decontamination": OP1_SQL,
    "op10_vector_duplicates": OP10_SQL,
    "op12_importance_resampling": OP12_SQL,
    "op13_phrases": OP13_SQL,
}
