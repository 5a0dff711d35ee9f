"""Query plans over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .registry import CHECKS, QUERIES, Query


def _load() -> None:
    from . import (  # noqa: F401
        application_queries, clean_queries, history_queries, market_queries, score_queries,
        skill_queries, source_queries, stream_queries, text_queries,
    )


def all_queries() -> dict[str, Query]:
    _load()
    return dict(QUERIES)


def all_checks() -> dict[str, str]:
    _load()
    return dict(CHECKS)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    _load()
    return QUERIES["A05_assess"](spark, sf_dir)
