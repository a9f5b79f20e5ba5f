"""The corpus queries: one opN_<name> for each operator, and the pipeline."""

from __future__ import annotations

import corpus_pipeline

from . import fingerprint, jaccard, language, license_scan, mixing, ngram_model, packing, periodic, quality, resharding, substring, toxicity, vector_codes

QUERIES = {
    "op1_substring": substring.op1_substring,
    "op2_fingerprint": fingerprint.op2_fingerprint,
    "op3_ngram_score": ngram_model.op3_ngram_score,
    "op4_packing": packing.op4_packing,
    "op5_quality": quality.op5_quality,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_mixing": mixing.op7_mixing,
    "op8_license": license_scan.op8_license,
    "op9_jaccard": jaccard.op9_jaccard,
    "op10_language": language.op10_language,
    "op11_periodic": periodic.op11_periodic,
    "op12_vector_codes": vector_codes.op12_vector_codes,
    "op13_resharding": resharding.op13_resharding,
    "pipeline": corpus_pipeline.run,
}

ORACLES = {
    "op9_jaccard": jaccard.OP9_SQL,
    "op5_quality": quality.OP5_SQL,
    "op11_periodic": periodic.OP11_SQL,
    "op12_vector_codes": vector_codes.OP12_SQL,
}
