"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tracewell.llm import audio, language, line_dedup, minhash, mixing, packing, quality_model, quality_rules, secrets_scan, sharding, source_audit, token_files, vector_codes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": language.op1_language_id,
    "op2_best_fit_packing": packing.op2_best_fit_packing,
    "op3_curriculum_mixing": mixing.op3_curriculum_mixing,
    "op4_secret_scans": secrets_scan.op4_secret_scans,
    "op5_minmax_near_dedup": minhash.op5_minmax_near_dedup,
    "op6_quality_classifier": quality_model.op6_quality_classifier,
    "op7_telephony_audio": audio.op7_telephony_audio,
    "op8_feistel_sharding": sharding.op8_feistel_sharding,
    "op9_weak_supervision_rules": quality_rules.op9_weak_supervision_rules,
    "op10_wavelet_token_files": token_files.op10_wavelet_token_files,
    "op11_vector_codes": vector_codes.op11_vector_codes,
    "op12_source_audit": source_audit.op12_source_audit,
    "op13_line_dedup": line_dedup.op13_line_dedup,
}

ORACLE_SQL: dict[str, str] = {
    "op3_curriculum_mixing": mixing.ORACLE_SQL,
    "op11_vector_codes": vector_codes.ORACLE_SQL,
    "op12_source_audit": source_audit.ORACLE_SQL,
    "op13_line_dedup": line_dedup.ORACLE_SQL,
}
