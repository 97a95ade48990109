"""The corpus operators' queries and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import exact_dedup, html_extraction, inverted_multi_index, jaccard, language_model, line_dedup, mixing, packing, token_files, toxicity

QUERIES = {
    "op1_html_extraction": html_extraction.op1_html_extraction,
    "op2_exact_dedup": exact_dedup.op2_exact_dedup,
    "op3_packing": packing.op3_packing,
    "op4_ngram_jaccard": jaccard.op4_ngram_jaccard,
    "op5_token_files": token_files.op5_token_files,
    "op6_line_dedup": line_dedup.op6_line_dedup,
    "op7_inverted_multi_index": inverted_multi_index.op7_inverted_multi_index,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_language_model": language_model.op9_language_model,
    "op10_mixing": mixing.op10_mixing,
}

ORACLES = {
    "op2_exact_dedup": exact_dedup.SQL,
}
