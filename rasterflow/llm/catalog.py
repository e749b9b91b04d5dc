"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from rasterflow.llm import centroids, exact_dedup, lm_scoring, mixing, ngram_join, packing, pieces, pii, quality_rules, secrets, token_blocks, url_rules, vector_codes

QUERIES = {
    "op1_token_blocks": token_blocks.op1,
    "op2_best_fit_packing": packing.op2,
    "op3_pii": pii.op3,
    "op4_quality_rules": quality_rules.op4,
    "op5_url_rules": url_rules.op5,
    "op6_exact_dedup": exact_dedup.op6,
    "op7_secrets": secrets.op7,
    "op8_sentence_pieces": pieces.op8,
    "op9_ngram_join": ngram_join.op9,
    "op10_lm_scoring": lm_scoring.op10,
    "op11_vector_codes": vector_codes.op11,
    "op12_centroids": centroids.op12,
    "op13_mixing": mixing.op13,
}

#: Where SQL can state the result.
ORACLES = {
    "op4_quality_rules": quality_rules.OP4_SQL,
    "op5_url_rules": url_rules.OP5_SQL,
    "op6_exact_dedup": exact_dedup.OP6_SQL,
    "op9_ngram_join": ngram_join.OP9_SQL,
    "op11_vector_codes": vector_codes.OP11_SQL,
    "op12_centroids": centroids.OP12_SQL,
    "op13_mixing": mixing.OP13_SQL,
}
