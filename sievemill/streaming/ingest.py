"""Restartable loading by Structured Streaming: new files are taken once, in checkpointed micro-batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemill.functions.models import CONTROL, ControlExtractor
from sievemill.operators import state
from sievemill.sources import sinks
from sievemill.sources.reports import page_batches


def ingest(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame], log: str | None = None, max_files: int = 1000) -> int:
    """Reads the JSON files not seen before, transforms and appends them, logs each file, and stops. Returns the batches.

    `transform` must be deterministic: after a failure a batch is repeated, and its rows replace those of the failed try,
    as every batch writes its own folder.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        transform(batch.drop("_file")).write.mode("overwrite").parquet(f"{target}/batch={number}")
        if log:
            seen = batch.groupBy(F.col("_file").alias("path")).agg(F.count("*").alias("n_rows"))
            seen.withColumn("status", F.lit("ok")).write.mode("overwrite").json(f"{log}/batch={number}")
        batch.unpersist()

    files = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).json(source).withColumn("_file", F.input_file_name())
    query = files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return len(query.recentProgress)


def rolling_fan_out(packets: DataFrame, ts: str = "ts", window: str = "1 minute", late: str = "5 minutes", least: int = 20) -> DataFrame:
    """Port scans on a stream: distinct ports per source in event-time windows, late rows within the watermark."""
    timed = packets.withColumn("_at", F.timestamp_seconds(ts)).withWatermark("_at", late)
    grouped = timed.where("proto IN ('TCP', 'UDP')").groupBy(F.window("_at", window), "src").agg(F.size(F.collect_set("dst_port")).alias("n_ports"))
    return grouped.where(F.col("n_ports") >= least).select(F.col("window.start").alias("window_start"), "src", "n_ports")


def ingest_batches(pages: DataFrame, extractor: ControlExtractor, target: str, log: str, *, size: int = 5, max_batches: int | None = None) -> int:
    """Controls of all page batches that the log does not hold as done; returns how many batches were tried.

    Batches run in parallel and fail by themselves: each writes its controls to `target` (one folder a run) and a log line
    with `ok` or `error` and the reason. A failed batch is taken up again by the next run, as only `ok` counts as done.
    """
    spark = pages.sparkSession
    batches = page_batches(pages, size)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(log)
    known = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    done = spark.read.schema(_LOG).json(log) if known else spark.createDataFrame([], _LOG)
    todo = state.first_rows(state.pending(batches, done, ["pdf_path", "batch_index"]), [F.col("pdf_path"), F.col("batch_index")], max_batches)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row in frame.itertuples():
                try:
                    out.append((row.pdf_path, row.batch_index, row.start_page, row.end_page, extractor.extract([row.text])[0], "ok", None))
                except Exception as e:  # one bad batch must not end the run
                    out.append((row.pdf_path, row.batch_index, row.start_page, row.end_page, None, "error", str(e)[:500]))
            yield pd.DataFrame(out, columns=["pdf_path", "batch_index", "start_page", "end_page", "raw", "status", "detail"])

    tried = state.checkpointed(todo.mapInPandas(run, "pdf_path string, batch_index int, start_page int, end_page int, raw string, status string, detail string"))
    rows = tried.where("status = 'ok'").withColumn("_c", F.explode(F.from_json("raw", f"array<{CONTROL}>"))).select("pdf_path", "batch_index", "_c.*")
    rows.write.mode("append").parquet(target)
    # The log comes last: a run that ends before it is repeated, and readers of `target` keep the first row of a control.
    tried.select("pdf_path", "batch_index", "start_page", "end_page", "status", "detail").write.mode("append").json(log)
    return tried.count()


_LOG = "pdf_path string, batch_index int, start_page int, end_page int, status string, detail string"


def ingest_controls(records: DataFrame, target: str, log: str, catalog: str) -> DataFrame:
    """Upserts catalog controls (key, control_id, remediation, mitre_ids) that the log does not hold; returns the new log lines.

    A control without text is `skipped`, which counts as done like `ok`.
    """
    spark = records.sparkSession
    schema = "kind string, catalog string, join_key string, status string"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(log)
    known = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    done = spark.read.schema(schema).json(log) if known else spark.createDataFrame([], schema)
    work = records.withColumn("catalog", F.lit(catalog)).withColumnRenamed("key", "join_key")
    todo = state.checkpointed(state.pending_controls(work, done))
    good = F.coalesce(F.trim("remediation"), F.lit("")) != ""
    sinks.upsert_table(spark, target, todo.where(good).select(F.col("join_key").alias("key"), "control_id", "remediation", "mitre_ids"), "key", [F.col("control_id")])
    lines = todo.select(F.lit("oscal").alias("kind"), "catalog", "join_key", F.when(good, "ok").otherwise("skipped").alias("status"))
    lines.write.mode("append").json(log)
    return lines
