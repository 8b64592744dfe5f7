"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from . import chat, decontaminate, exact, jaccard, langid, lm, mixing, sharding, tokens, toxicity

_OPERATORS = {
    "op1_lm_scoring": lm,
    "op2_decontamination": decontaminate,
    "op3_toxicity": toxicity,
    "op4_exact_dedup": exact,
    "op5_mixing": mixing,
    "op6_ngram_jaccard": jaccard,
    "op7_language_id": langid,
    "op8_token_binary": tokens,
    "op9_chat": chat,
    "op10_sharding": sharding,
}

QUERIES = {name: module.query for name, module in _OPERATORS.items()}
ORACLES = {name: module.SQL for name, module in _OPERATORS.items() if getattr(module, "SQL", None)}
