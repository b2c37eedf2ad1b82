"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from . import alignment, chat, dedup, jaccard, language, licenses, mixing, packing, sharding, tokens, toxicity, vectors, whitening

QUERIES = {
    "op1_licenses": licenses.op1_licenses,
    "op2_language": language.op2_language,
    "op3_packing": packing.op3_packing,
    "op4_jaccard": jaccard.op4_jaccard,
    "op5_sharding": sharding.op5_sharding,
    "op6_mixing": mixing.op6_mixing,
    "op7_exact_dedup": dedup.op7_exact_dedup,
    "op8_chat": chat.op8_chat,
    "op9_embeddings": vectors.op9_embeddings,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_alignment": alignment.op11_alignment,
    "op12_whitening": whitening.op12_whitening,
    "op13_tokens": tokens.op13_tokens,
}

ORACLE_SQL = {
    "op1_licenses": licenses.OP1_SQL,
    "op4_jaccard": jaccard.OP4_SQL,
    "op6_mixing": mixing.OP6_SQL,
    "op7_exact_dedup": dedup.OP7_SQL,
    "op8_chat": chat.OP8_SQL,
    "op9_embeddings": vectors.OP9_SQL,
}
