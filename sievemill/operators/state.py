"""Checkpoints, resume by log, and limits."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemill.functions import text
from sievemill.operators.common import top_n


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from `spark.checkpoint.dir`; a temporary one only on a local master."""
    sc = spark.sparkContext
    where = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.mkdtemp(prefix="sievemill-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(where)
    return where


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """The rows as a Parquet table in the shared folder, for steps that read some of its columns or rows."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def pending(work: DataFrame, log: DataFrame, keys: list[str], done: tuple[str, ...] = ("ok",)) -> DataFrame:
    """Work rows without a log row of a status that counts as done; null-safe on the keys."""
    finished = log.where(F.col("status").isin(list(done))).select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct()
    match = [work[k].eqNullSafe(finished[f"_{k}"]) for k in keys]
    cond = match[0]
    for m in match[1:]:
        cond = cond & m
    return work.join(finished, cond, "left_anti")


def pending_controls(work: DataFrame, log: DataFrame) -> DataFrame:
    """Controls whose (catalog, join_key) has no `ok` or `skipped` entry of the oscal kind."""
    return pending(work, log.where("kind = 'oscal'"), ["catalog", "join_key"], ("ok", "skipped"))


def per_group_limit(df: DataFrame, keys: list[str], order: list[Column], n: int | None) -> DataFrame:
    """The first n rows of each group; 0 or None keeps all."""
    return top_n(df, keys, order, n).drop("rank") if n else df


def first_rows(df: DataFrame, order: list[Column], n: int | None) -> DataFrame:
    """The first n rows over all; 0 or None keeps all."""
    return df.orderBy(*order).limit(n) if n else df


def cache_lookup(keys: DataFrame, cache: DataFrame, key: str = "key", value: str = "summary") -> DataFrame:
    """Adds the cached value (null on a miss) and `hit`."""
    stored = cache.groupBy(key).agg(F.max(value).alias(value), F.lit(True).alias("hit"))
    return keys.join(stored, key, "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def cache_put(cache: DataFrame, made: DataFrame, key: str = "key", value: str = "summary") -> DataFrame:
    """The cache with new model summaries: valid ones only, keys it holds already keep their value.

    `made` has key, value and `summary_source`; plain sentences and invalid texts are never stored.
    """
    good = made.where((F.col("summary_source") == "model") & F.coalesce(text.valid_summary(value), F.lit(False)) & F.col(key).isNotNull())
    fresh = good.groupBy(key).agg(F.min(value).alias(value)).join(cache.select(key), key, "left_anti")
    return cache.select(key, value).unionByName(fresh)


def hit_rate(looked_up: DataFrame) -> DataFrame:
    return looked_up.agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses")).withColumn("hit_rate", F.coalesce(F.try_divide("hits", F.col("hits") + F.col("misses")), F.lit(0.0)))


def mapper_input(findings: DataFrame) -> DataFrame:
    """What the mapper is asked with: summary, source metadata, score, title, ids, services, ports.

    The score falls back to the CVSS score; metadata holds only values that are there; a null title is empty and null lists
    are. Findings without a summary are left out (`stats.run_stats` counts them).
    """
    none = F.array().cast("array<string>")
    own = findings.columns
    col = lambda c, kind="string": F.col(c) if c in own else F.lit(None).cast(kind)
    pairs = F.filter(F.array(*[F.struct(F.lit(k).alias("key"), col(k).alias("value")) for k in ("hostname", "log_source", "source_ip", "destination_ip")]), lambda e: e["value"].isNotNull())
    score = F.coalesce(col("severity_score", "double"), col("cvss_score", "double"))
    lists = [F.coalesce(col(c, "array<string>"), none).alias(c) for c in ("cve_ids", "services", "ports")]
    return findings.where(text.safe_str("technical_summary") != "").select("finding_id", "technical_summary", F.map_from_entries(pairs).alias("source_metadata"), score.alias("severity_score"), F.coalesce(col("title"), F.lit("")).alias("title"), *lists)


def reference_rows(rows: DataFrame) -> DataFrame:
    """technical_summary, mitre_ids, similarity_score of retrieved rows under any of their names; first filled one wins.

    Ids may be lists (mitre_ids, verified_mitre_ids) or one id as text (mitre_id).
    """
    own = rows.columns
    filled = [text.blank_to_null(c) for c in ("technical_summary", "summary", "text") if c in own]
    lists = [F.when(F.size(c) > 0, F.col(c)) for c in ("mitre_ids", "verified_mitre_ids") if c in own] + [F.when(text.safe_str("mitre_id") != "", F.array("mitre_id")) for _ in (1,) if "mitre_id" in own]
    scores = [F.col(c).cast("double") for c in ("similarity_score", "score") if c in own]
    kept = [c for c in ("query_id",) if c in own]
    return rows.select(*kept, F.coalesce(*filled, F.lit("")).alias("technical_summary"), F.coalesce(*lists, F.array().cast("array<string>")).alias("mitre_ids"), F.coalesce(*scores, F.lit(None).cast("double")).alias("similarity_score"))
