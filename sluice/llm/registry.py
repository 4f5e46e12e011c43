"""The operators' queries, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, classifier, decontaminate, language_model, lines, neardup, oracle, pages, phrases, rules, suffixes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        classifier.op1_quality_classifier,
        language_model.op2_lm_scoring,
        rules.op3_quality_rules,
        bpe.op4_byte_bpe,
        lines.op5_line_dedup,
        neardup.op6_minhash_near_dedup,
        decontaminate.op7_benchmark_decontamination,
        pages.op8_html_extraction,
        suffixes.op9_suffix_array_dedup,
        phrases.op10_substring_dedup,
    )
}

ORACLE_SQL: dict[str, str] = oracle.SQL
