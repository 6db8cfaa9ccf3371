"""The queries of the corpus operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from arborlake.llm import op1, op2, op3, op4, op5, op6, op7, op8, op9, op10


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """One query an operator."""
    return {
        "op1_quality": op1.op1_quality,
        "op2_exact_dedup": op2.op2_exact_dedup,
        "op3_license_scan": op3.op3_license_scan,
        "op4_mix_sources": op4.op4_mix_sources,
        "op5_language_id": op5.op5_language_id,
        "op6_bpe": op6.op6_bpe,
        "op7_simhash": op7.op7_simhash,
        "op8_warc_fixity": op8.op8_warc_fixity,
        "op9_toxicity": op9.op9_toxicity,
        "op10_repeated_passages": op10.op10_repeated_passages,
    }


def oracle_sql() -> dict[str, str]:
    """SQL of those that DuckDB can run on whole tables."""
    return {
        "op2_exact_dedup": op2.SQL,
        "op4_mix_sources": op4.SQL,
        "op8_warc_fixity": op8.SQL,
    }
