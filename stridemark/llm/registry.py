"""Queries of this subpackage and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, fingerprints, language, mixing, neighbours, passages, pieces, secrets, simhash, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_substring_dedup": passages.query,
        "op2_fingerprints": fingerprints.query,
        "op3_simhash": simhash.query,
        "op4_toxicity": toxicity.query,
        "op5_bpe": bpe.query,
        "op6_token_counts": pieces.query,
        "op7_mixing": mixing.query,
        "op8_nearest_neighbours": neighbours.query,
        "op9_language_id": language.query,
        "op10_secrets": secrets.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_substring_dedup": passages.ORACLE, "op7_mixing": mixing.ORACLE, "op8_nearest_neighbours": neighbours.ORACLE}
