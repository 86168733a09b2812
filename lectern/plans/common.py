"""Shared pieces of the registered queries and of their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, *tables: str, sql: str | None = None):
    """Register fn(*tables) under ``name``; the tables are read below sf_dir."""

    def register(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(*(table(spark, sf_dir, t) for t in tables))
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def spread_out(rows: DataFrame, *keys: str) -> DataFrame:
    """Small rows that make long work, dealt (by key, if one is given) to tasks a few times as many as the cores; else a small file is one task."""
    return rows.repartition(8 * rows.sparkSession.sparkContext.defaultParallelism, *keys)


# ---- DuckDB fragments ------------------------------------------------------------------


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def words(x: str) -> str:
    return rf"list_filter(regexp_split_to_array({x}, '\s+'), lambda w: w <> '')"


def pieces(x: str, pattern: str) -> str:
    return f"list_filter(list_transform(regexp_split_to_array({x}, '{pattern}'), lambda p: {strip('p')}), lambda p: p <> '')"


def sentences(x: str) -> str:
    cut = rf"""regexp_replace({x}, '([.!?…])(?:\s*["''”’])?\s+', '\1' || chr(1), 'g')"""
    return f"list_filter(list_transform(string_split({cut}, chr(1)), lambda q: {strip('q')}), lambda q: q <> '')"


def sentences_by_capital(x: str) -> str:
    cut = rf"""regexp_replace({x}, '([.!?])\s+([A-Z"“])', '\1' || chr(1) || '\2', 'g')"""
    return f"list_filter(list_transform(string_split({cut}, chr(1)), lambda q: {strip('q')}), lambda q: q <> '')"


def any_of(x: str, patterns) -> str:
    return "(" + " or ".join(f"coalesce(regexp_matches({x}, '{p}'), false)" for p in patterns) + ")"


def listed(values) -> str:
    return "[" + ", ".join("'" + str(v).replace("'", "''") + "'" for v in values) + "]"


def rms(x: str) -> str:
    return f"sqrt(list_sum(list_transform({x}, lambda v: v * v)) / len({x}))"


def clip(x: str) -> str:
    return f"greatest(-1.0, least(1.0, {x}))"


def duration(x: str, per: str = "2.5") -> str:
    return f"greatest(0.3, len({words(x)}) / {per})"
