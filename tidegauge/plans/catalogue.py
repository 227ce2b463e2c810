"""The registered queries and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidegauge.plans import packs, reporting, sequential

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**packs.QUERIES, **sequential.QUERIES}
SQL: dict[str, str] = {**packs.SQL, **sequential.SQL}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy and skill of the baseline forecasts by arm, signal and horizon, on a six-hour grid."""
    return reporting.skill_report(spark, sf_dir)
