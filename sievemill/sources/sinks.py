"""Sinks: nested packet JSON, Parquet stores, upserts, logs, graph JSON and CSV exports."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def nested(packets: DataFrame, findings: DataFrame) -> DataFrame:
    """Packets with their findings as an array ordered by row_no, and counts made from them.

    A packet is one source file; its findings fit one row, as they did in the file.
    """
    own = [c for c in findings.columns if c != "packet_id"]
    severity = F.lower(F.trim("severity"))
    grouped = findings.groupBy("packet_id").agg(F.array_sort(F.collect_list(F.struct("row_no", *[c for c in own if c != "row_no"]))).alias("findings"), F.count("*").alias("finding_count"), F.count_if(severity == "critical").alias("critical_count"), F.count_if(severity == "high").alias("high_count"))
    kept = packets.drop("finding_count", "critical_count", "high_count", "findings")
    return kept.join(grouped, "packet_id", "left").fillna(0, ["finding_count", "critical_count", "high_count"])


def as_json(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("value"))


def write_json(df: DataFrame, path: str, partition: str | None = None, mode: str = "overwrite") -> None:
    """One JSON object per line; partitioned output is clustered first, so a key's rows make one file."""
    if partition:
        df.repartition(partition).write.mode(mode).partitionBy(partition).json(path)
    else:
        df.write.mode(mode).json(path)


def write_store(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).parquet(path)


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def swap(df: DataFrame, path: str) -> None:
    """Writes beside the target and renames, so that a table may be rewritten from itself."""
    spark = df.sparkSession
    side = f"{path}.{uuid.uuid4().hex[:8]}"
    df.write.parquet(side)
    jvm = spark.sparkContext._jvm
    target, fresh, old = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, side, f"{side}.old"))
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(target):
        fs.rename(target, old)
    fs.rename(fresh, target)
    fs.delete(old, True)


def upsert_table(spark: SparkSession, path: str, incoming: DataFrame, key: str, order: list) -> None:
    from sievemill.operators.graph import upsert

    exists = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = exists.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    stored = spark.read.parquet(path) if fs.exists(exists) else spark.createDataFrame([], incoming.schema)
    swap(upsert(stored, incoming, key, order), path)


def load_collection(records: DataFrame, path: str, order: list[str]) -> None:
    """Vector collection with ids from 1 in a stable order."""
    from sievemill.operators.graph import numbered

    keyed = records.withColumn("_key", F.sha2(F.to_json(F.struct(*order)), 256)).dropDuplicates(["_key"])
    made = numbered(keyed, "_key", "id").withColumn("id", F.col("id") + 1).drop("_key")
    write_store(made, path)


def graph_json(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """One line per node and link with its kind; a single document would have to pass through one task."""
    n = nodes.select(F.to_json(F.struct(F.lit("node").alias("kind"), *nodes.columns)).alias("value"))
    return n.unionByName(links.select(F.to_json(F.struct(F.lit("link").alias("kind"), *links.columns)).alias("value")))


def graph_document(nodes: DataFrame, links: DataFrame, most: int = 200_000) -> DataFrame:
    """The whole graph as one JSON document, for viewers; larger graphs than `most` rows are an error."""
    if nodes.limit(most + 1).count() + links.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} nodes and links; use graph_json")
    n = nodes.agg(F.array_sort(F.collect_list(F.struct(*nodes.columns))).alias("nodes"))
    return n.crossJoin(links.agg(F.array_sort(F.collect_list(F.struct(*links.columns))).alias("links"))).select(F.to_json(F.struct("nodes", "links")).alias("value"))  # one row each


def write_csv(df: DataFrame, path: str, order: list) -> None:
    """A sorted CSV with a header; files follow the sort order."""
    df.orderBy(*order).write.mode("overwrite").csv(path, header=True)


def output_name(stem: str, packet_id: str) -> str:
    return f"{os.path.basename(stem)}_{packet_id[:8]}.json"


def stage_name(stem: str, stage: str, stamp: str) -> str:
    """File name of a packet after a stage (`enriched`, `mapped`, `remediated`), with a UTC stamp; remediation drops `_correlated`."""
    base = os.path.basename(stem)
    return f"{base.removesuffix('_correlated') if stage == 'remediated' else base}_{stage}_{stamp}.json"


def write_checked(df: DataFrame, path: str, keys: list[str]) -> None:
    """A store whose keys are unique; repeated ones are an error and nothing is written."""
    from sievemill.operators.graph import violations

    for key in keys:
        if not violations(df.where(F.col(key).isNotNull()), key).isEmpty():
            raise ValueError(f"{key} is not unique")
    write_store(df, path)
