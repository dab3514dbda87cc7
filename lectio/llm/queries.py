"""Registered queries of the subpackage: one per operator, with DuckDB SQL where it exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lectio.llm import op01_near_vectors, op02_warc, op03_quality, op04_decontamination, op05_jaccard_join, op06_secrets, op07_mixing, op08_lattice, op09_chat, op10_licenses, op11_link_filter, op12_codes, op13_spelling

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_near_vectors": op01_near_vectors.op1_near_vectors,
    "op2_warc_transactions": op02_warc.op2_warc_transactions,
    "op3_quality_resampling": op03_quality.op3_quality_resampling,
    "op4_benchmark_leaks": op04_decontamination.op4_benchmark_leaks,
    "op5_jaccard_join": op05_jaccard_join.op5_jaccard_join,
    "op6_secret_scan": op06_secrets.op6_secret_scan,
    "op7_source_mixing": op07_mixing.op7_source_mixing,
    "op8_lattice_scoring": op08_lattice.op8_lattice_scoring,
    "op9_chat_formatting": op09_chat.op9_chat_formatting,
    "op10_license_scan": op10_licenses.op10_license_scan,
    "op11_link_filter": op11_link_filter.op11_link_filter,
    "op12_vector_codes": op12_codes.op12_vector_codes,
    "op13_spelling_variants": op13_spelling.op13_spelling_variants,
}

ORACLE: dict[str, str] = {
    "op1_near_vectors": op01_near_vectors.ORACLE,
    "op2_warc_transactions": op02_warc.ORACLE,
    "op5_jaccard_join": op05_jaccard_join.ORACLE,
    "op6_secret_scan": op06_secrets.ORACLE,
    "op9_chat_formatting": op09_chat.ORACLE,
    "op11_link_filter": op11_link_filter.ORACLE,
    "op12_vector_codes": op12_codes.ORACLE,
    "op13_spelling_variants": op13_spelling.ORACLE,
}
