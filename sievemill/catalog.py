"""Registry of the engine's own queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sievemill.plans import correlation, extraction, findings, labels, structure  # noqa: F401  (they register their queries)
from sievemill.plans.registry import QUERIES, SQL, Query


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return correlation.composite_top_n(spark, sf_dir)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
