"""Queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import lm_scoring, media, mixing, near_dedup, packing, pii, quality, quality_rules, token_files, url_filters

_OPERATORS = (
    lm_scoring.op1_lm_scoring,
    media.op2_media_columns,
    mixing.op3_mixing,
    quality_rules.op4_quality_rules,
    url_filters.op5_url_filters,
    pii.op6_pii,
    packing.op7_packing,
    token_files.op8_token_files,
    quality.op9_quality_classifier,
    near_dedup.op10_near_dedup,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _OPERATORS}


def oracle_sql() -> dict[str, str]:
    return {"op1_lm_scoring": lm_scoring.SQL, "op5_url_filters": url_filters.SQL, "op10_near_dedup": near_dedup.SQL}
