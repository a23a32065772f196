"""All registered queries."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from checks import evaluation_queries, export_queries, file_queries, label_queries, model_queries, text_queries  # noqa: F401
from checks.registry import ORACLES, QUERIES
from postloom import session


def ship_packages(spark: SparkSession) -> None:
    """Send both packages to the Python workers once per application."""
    session.ship_packages(spark, "postloom", "checks")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def runnable(fn):
        @functools.wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_packages(spark)
            return fn(spark, sf_dir)

        return run

    return {name: runnable(fn) for name, fn in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
