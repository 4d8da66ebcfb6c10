"""All queries of the core, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sievework.plans import evaluation, measurement, pages, reference, training

MODULES = [training, evaluation, reference, measurement, pages]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Queries by name."""
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracles() -> dict[str, str]:
    """SQL by query name."""
    return {k: s for m in MODULES for k, s in m.ORACLES.items()}


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """The query that the driver runs first."""
    return evaluation.leaderboard(spark, folder)
