"""The queries of this package and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarryline.llm import decontaminate, html_extract, language_id, merkle, minhash, quality_classifier, quality_rules, secret_scan, sentencepiece_codec, substring_dedup, token_files, toxicity, turn_repair

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scan": secret_scan.op1_secret_scan,
    "op2_decontaminate": decontaminate.op2_decontaminate,
    "op3_sentencepiece": sentencepiece_codec.op3_sentencepiece,
    "op4_language_id": language_id.op4_language_id,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_substring_dedup": substring_dedup.op6_substring_dedup,
    "op7_quality_classifier": quality_classifier.op7_quality_classifier,
    "op8_html_extract": html_extract.op8_html_extract,
    "op9_quality_rules": quality_rules.op9_quality_rules,
    "op10_minhash": minhash.op10_minhash,
    "op11_merkle_manifest": merkle.op11_merkle_manifest,
    "op12_turn_repair": turn_repair.op12_turn_repair,
    "op13_token_files": token_files.op13_token_files,
}

SQL: dict[str, str] = {
    "op2_decontaminate": decontaminate.SQL_OP2,
    "op6_substring_dedup": substring_dedup.SQL_OP6,
    "op9_quality_rules": quality_rules.SQL_OP9,
    "op10_minhash": minhash.SQL_OP10,
    "op11_merkle_manifest": merkle.SQL_OP11,
    "op12_turn_repair": turn_repair.SQL_OP12,
}
