"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from . import collocations, exact_dedup, hard_negatives, language, license_scan, media, mixing, ngram_join, packing, quality, sharding, substring_dedup, toxicity

QUERIES = {
    "op1_exact_dedup": exact_dedup.query,
    "op2_quality_rules": quality.query,
    "op3_source_mixing": mixing.query,
    "op4_uniform_shards": sharding.query,
    "op5_harmonic_packing": packing.query,
    "op6_ngram_jaccard_join": ngram_join.query,
    "op7_license_scan": license_scan.query,
    "op8_toxicity": toxicity.query,
    "op9_transport_streams": media.query,
    "op10_substring_dedup": substring_dedup.query,
    "op11_collocations": collocations.query,
    "op12_language": language.query,
    "op13_hard_negatives": hard_negatives.query,
}

#: op2, op4, op5, op8, op9 and op12 have no SQL: tests hold them against brute force or held-out labels.
ORACLES = {
    "op1_exact_dedup": exact_dedup.ORACLE,
    "op3_source_mixing": mixing.ORACLE,
    "op6_ngram_jaccard_join": ngram_join.ORACLE,
    "op7_license_scan": license_scan.ORACLE,
    "op10_substring_dedup": substring_dedup.ORACLE,
    "op11_collocations": collocations.ORACLE,
    "op13_hard_negatives": hard_negatives.ORACLE,
}
