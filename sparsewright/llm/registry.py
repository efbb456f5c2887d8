"""The subpackage's queries and their SQL, for the entry module."""

from __future__ import annotations

from sparsewright.llm import decontaminate, language_id, license_scan, line_dedup, ngram_join, piece_codec, quality_classifier, quality_rules, suffix_dedup, toxicity
from sparsewright.plans.session import shipped

QUERIES = {
    "op1_suffix_dedup": suffix_dedup.op1_suffix_dedup,
    "op2_piece_codec": piece_codec.op2_piece_codec,
    "op3_line_dedup": line_dedup.op3_line_dedup,
    "op4_ngram_join": ngram_join.op4_ngram_join,
    "op5_decontaminate": decontaminate.op5_decontaminate,
    "op6_quality_classifier": quality_classifier.op6_quality_classifier,
    "op7_language_id": language_id.op7_language_id,
    "op8_quality_rules": quality_rules.op8_quality_rules,
    "op9_license_scan": license_scan.op9_license_scan,
    "op10_toxicity": toxicity.op10_toxicity,
}
SQL = {
    "op3_line_dedup": line_dedup.OP3_SQL,
    "op4_ngram_join": ngram_join.OP4_SQL,
    "op5_decontaminate": decontaminate.OP5_SQL,
    "op9_license_scan": license_scan.sql(),
}

QUERIES = {name: shipped(f) for name, f in QUERIES.items()}
