"""The queries of this subpackage, by name, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import exact_dedup, infill, language, line_dedup, neighbours, ngram_join, packing, pii, secrets, token_files, tokens, turns


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            tokens.op1_bpe_round_trip,
            ngram_join.op2_ngram_join,
            secrets.op3_secrets,
            pii.op4_pii,
            language.op5_language_id,
            neighbours.op6_nearest,
            packing.op7_packing,
            exact_dedup.op8_exact_dedup,
            tokens.op9_token_counts,
            token_files.op10_token_files,
            turns.op11_conversation_repair,
            line_dedup.op12_line_dedup,
            infill.op13_fill_in_middle,
        )
    }


def oracle_sql() -> dict[str, str]:
    return {**exact_dedup.ORACLE, **turns.ORACLE, **line_dedup.ORACLE, **infill.ORACLE}
