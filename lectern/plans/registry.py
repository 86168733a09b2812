"""All registered queries of the reference operators, with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import audio_queries, source_queries, stream_queries, table_queries, text_queries  # noqa: F401  they register
from .common import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracles() -> dict[str, str]:
    return dict(ORACLES)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents packed into chunks bounded in speaking time."""
    return QUERIES["t16_greedy_chunks"](spark, sf_dir)
