"""Queries of the corpus operators, and SQL twins where SQL can express them."""

from __future__ import annotations

from footfall.llm import chroma, html, jaccard, lm, packing, pieces, quality, repeats, sharding, toxicity

QUERIES = {
    "op1_chroma_fingerprint": chroma.query,
    "op2_sampled_splitters": sharding.query,
    "op3_piece_viterbi": pieces.query,
    "op4_line_frequency": quality.query,
    "op5_min_slack_packing": packing.query,
    "op6_ngram_jaccard": jaccard.query,
    "op7_template_classes": html.query,
    "op8_convolution": toxicity.query,
    "op9_backoff_automaton": lm.query,
    "op10_transform_merge": repeats.query,
}

ORACLES = {
    "op4_line_frequency": quality.ORACLE,
    "op6_ngram_jaccard": jaccard.ORACLE,
    "op10_transform_merge": repeats.ORACLE,
}
