"""Pieces the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from `spark.checkpoint.dir`; a temporary one only on a local master."""
    sc = spark.sparkContext
    where = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.mkdtemp(prefix="sievemill-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(where)
    return where


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: ends the lineage and survives the loss of executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """The rows as a Parquet table in the shared folder: like `cut`, but later steps read only the columns they use."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """A scan with fewer partitions than cores (a few large row groups) is spread before heavy per-row work.

    Only the physical layout changes; a scan of many files passes through untouched, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def latest(df: DataFrame, keys: list[str], by: list[str], keep: list[str]) -> DataFrame:
    """One row per key: the greatest `by` tuple wins, then the greatest kept values; null orders lowest.

    Rows with a null key are dropped, as they name no record. It is one map-side combined aggregation.
    """
    order = F.struct(*[F.col(c) for c in by], *[F.col(c) for c in keep])
    live = df.where(F.lit(True) if not keys else ~F.greatest(*[F.col(k).isNull() for k in keys], F.lit(False)))
    best = live.groupBy(*keys).agg(F.max(order).alias("_best"))
    return best.select(*keys, *[F.col(f"_best.{c}").alias(c) for c in keep])


def words(text: Column) -> Column:
    """Maximal runs of a-z and 0-9 after lower-casing; null text has none."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))
