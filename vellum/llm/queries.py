"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import decontaminate, language, near_join, oracles, pieces, spotsigs, suffix_tree, token_counts, token_shards, toxicity, warc

QUERIES = {
    "op1_decontaminate": decontaminate.query,
    "op2_fingerprints": spotsigs.query,
    "op3_token_shards": token_shards.query,
    "op4_jaccard_join": near_join.query,
    "op5_suffix_tree": suffix_tree.query,
    "op6_toxicity": toxicity.query,
    "op7_token_counts": token_counts.query,
    "op8_sentencepiece": pieces.query,
    "op9_warc": warc.query,
    "op10_language": language.query,
}

ORACLES: dict[str, str] = {
    "op1_decontaminate": oracles.DECONTAMINATE,
    "op4_jaccard_join": oracles.JACCARD,
    "op9_warc": warc.ORACLE,
}
