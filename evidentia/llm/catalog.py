"""Registered queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from evidentia.llm import (
    chat_format,
    checking_sql,
    collocations,
    decontaminate,
    html_cut,
    line_dedup,
    line_frequency,
    packing,
    secret_scan,
    simhash_dedup,
    spelling,
    suffix_dedup,
    token_counts,
    toxicity,
)

QUERIES = (
    html_cut.op1_html_cut,
    decontaminate.op2_decontamination,
    secret_scan.op3_secret_scan,
    toxicity.op4_toxicity,
    simhash_dedup.op5_simhash_dedup,
    suffix_dedup.op6_suffix_dedup,
    token_counts.op7_token_counts,
    packing.op8_packing,
    chat_format.op9_chat_format,
    line_frequency.op10_line_frequency,
    line_dedup.op11_line_dedup,
    collocations.op12_phrase_collocations,
    spelling.op13_spelling_variants,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return dict(checking_sql.SQL)
