"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import (
    exact_dedup,
    language_id,
    lm_scoring,
    merkle,
    mixing,
    sentencepiece_codec,
    simhash,
    sketch,
    suffix_dedup,
    token_counts,
    toxicity,
    warc,
    whitening,
)

QUERIES = {
    "op1_mixing": mixing.op1_mixing,
    "op2_lm_scoring": lm_scoring.op2_lm_scoring,
    "op3_sentencepiece": sentencepiece_codec.op3_sentencepiece,
    "op4_token_counts": token_counts.op4_token_counts,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_simhash": simhash.op6_simhash,
    "op7_suffix_dedup": suffix_dedup.op7_suffix_dedup,
    "op8_fingerprints": sketch.op8_fingerprints,
    "op9_exact_dedup": exact_dedup.op9_exact_dedup,
    "op10_language_id": language_id.op10_language_id,
    "op11_merkle": merkle.op11_merkle,
    "op12_whitening": whitening.op12_whitening,
    "op13_warc": warc.op13_warc,
}

SQL = {
    "op1_mixing": mixing.SQL,
    "op9_exact_dedup": exact_dedup.SQL,
    "op11_merkle": merkle.SQL,
    "op13_warc": warc.SQL,
}
