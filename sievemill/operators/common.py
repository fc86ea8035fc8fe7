"""Small relational idioms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One whole row per key, the first by `order`. A rank filter, so each partition keeps one row before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def latest(df: DataFrame, keys: list[str], by: list[Column]) -> DataFrame:
    """One row per key: the greatest `by` values, then the greatest of the other columns in their order; null is least.

    A maximum with map-side combine, not a sort. It reads all columns of `df`, so select those needed before.
    """
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max(F.struct(F.struct(*by).alias("_by"), *rest)).alias("_best"))
    return best.select(*[F.col(c) if c in keys else F.col(f"_best.{c}").alias(c) for c in df.columns])


def top_n(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    made = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn(rank, made).where(F.col(rank) <= n)


def small(df: DataFrame, rows: int = 200_000) -> DataFrame:
    """A broadcast hint only behind a count of at most `rows`; otherwise the optimizer picks the join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def union_all(*dfs: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)
