"""Folder ingest over all formats: findings of every file, and an error row for every file that cannot be read."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievemill.functions import text
from sievemill.operators import detect
from sievemill.operators.common import union_all
from sievemill.operators.state import stored
from sievemill.sources import csvs, jsons, pcap, reports

#: Different CSV headers in a folder; each is one read, so more are an error.
MAX_HEADERS = 200


@dataclass
class Folder:
    findings: DataFrame  # path, row_no, finding_id and the finding columns of the format
    errors: DataFrame  # path, error


def _one_form(path: str):
    """Local paths as `file:///...`; Spark spells them in two ways."""
    return F.regexp_replace(path, "^file:/+", "file:///").alias("path")


def listing(spark: SparkSession, folder: str, recursive: bool = False) -> DataFrame:
    """path and format of the files with a known suffix."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder).select(_one_form("path"))
    kind = F.create_map(*[F.lit(x) for pair in jsons.FORMATS.items() for x in pair])
    return files.withColumn("format", kind[F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1))]).where("format IS NOT NULL")


def _first_lines(paths: DataFrame) -> DataFrame:
    """path, head (the first line) or error of text files; each worker reads one line of a file."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for path in frame.path:
                try:
                    store, where = pcap.store_of(path)
                    with store.open_input_stream(where) as f:
                        head = f.read(1 << 16).split(b"\n", 1)[0].decode("utf-8", "replace").rstrip("\r")
                    out.append((path, head or None, None if head.strip() else "no header"))
                except Exception as e:  # one bad file must not end the ingest
                    out.append((path, None, str(e)[:500]))
            yield pd.DataFrame(out, columns=["path", "head", "error"])

    return paths.select("path").mapInPandas(run, "path string, head string, error string")


def _csv(spark: SparkSession, paths: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    heads = _first_lines(paths)
    good = heads.where("error IS NULL").groupBy("head").agg(F.collect_list("path").alias("paths")).limit(MAX_HEADERS + 1).collect()  # paths only
    if len(good) > MAX_HEADERS:
        raise ValueError(f"more than {MAX_HEADERS} different CSV headers")
    made = []
    for r in good:
        rows = csvs.read(spark, r.paths, encoding=csvs.encoding_of(spark, r.paths))
        located = rows.withColumn("_path", _one_form("_metadata.file_path"))
        found = csvs.findings(located, extra=["_path"])
        first = F.min("row_no").over(Window.partitionBy("_path"))
        made.append(found.withColumn("row_no", F.col("row_no") - first).withColumnRenamed("_path", "path").drop("source_file"))
    return made, heads.where("error IS NOT NULL").select("path", "error")


def ingest(spark: SparkSession, folder: str, *, recursive: bool = False, extract: Callable[[bytes], list[str]] | None = None) -> Folder:
    """Findings of all CSV, capture, report and packet files of a folder.

    Files of one format are read together, CSV files by header. Reports need `extract`, which makes page texts of a file's
    bytes; without it they are errors, as files are that cannot be opened, hold no header or no capture. Files without any
    bytes are not listed. Ids are hashes of path and row, so a second ingest gives the same ones.
    """
    files = listing(spark, folder, recursive)
    kinds = {r.format for r in files.select("format").distinct().collect()}  # at most the known formats
    parts: list[DataFrame] = []
    errors: list[DataFrame] = [spark.createDataFrame([], "path string, error string")]
    if "csv" in kinds:
        made, bad = _csv(spark, files.where("format = 'csv'"))
        parts += made
        errors.append(bad)
    if "report" in kinds:
        if extract is None:
            errors.append(files.where("format = 'report'").select("path", F.lit("no extractor for reports").alias("error")))
        else:
            own = stored(reports.pages(spark, folder, extract))  # read and extracted once
            read = own.withColumn("path", _one_form("path")).join(files.select("path"), "path", "left_semi")
            errors.append(read.where("error IS NOT NULL").select("path", "error"))
            page = F.struct("page_no", F.coalesce("page_text", F.lit("")).alias("t"))
            whole = read.where("error IS NULL").groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(page)), lambda p: p["t"]), "\n").alias("body"))  # a report is one file
            parts.append(reports.findings(whole, "path", "body").withColumnRenamed("doc_id", "path").withColumn("row_no", F.col("row_no").cast("bigint")))
    if "capture" in kinds:
        rows, bad = _captures(spark, files.where("format = 'capture'"))
        parts.append(rows)
        errors.append(bad)
    if "packet" in kinds:
        packets = jsons.packets(spark, folder).withColumn("path", _one_form("path"))
        own = jsons.packet_findings(packets.withColumn("id", F.col("path"))).withColumnRenamed("packet_id", "path").drop("finding_id")
        parts.append(own.withColumn("row_no", F.col("row_no").cast("bigint")))
        errors.append(files.where("format = 'packet'").join(packets.where("id IS NOT NULL").select("path"), "path", "left_anti").select("path", F.lit("no packet").alias("error")))
    none = spark.createDataFrame([], "path string, row_no bigint, title string, severity string, description string")
    found = union_all(none, *parts).withColumn("finding_id", text.node_id(F.col("path"), F.col("row_no").cast("string"), prefix="", size=32))
    return Folder(found, union_all(*errors))


def _captures(spark: SparkSession, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Detector rows of each capture by itself (the path is part of every address), and captures that are none."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path in frame.path:
                out, error = [], None
                try:
                    store, where = pcap.store_of(path)
                    with store.open_input_stream(where, buffer_size=1 << 20) as f:
                        for seq, (_, link, size, data) in enumerate(pcap.frames(f)):
                            if got := pcap.parsed(link, data):
                                out.append((path, seq, *got, size, None))
                            if len(out) >= 50_000:
                                yield pd.DataFrame(out, columns=_CAPTURE)
                                out = []
                except Exception as e:
                    error = str(e)[:500]
                if error:
                    out.append((path, None, None, None, None, None, None, error))
                yield pd.DataFrame(out, columns=_CAPTURE)

    read = files.select("path").mapInPandas(run, "path string, seq bigint, src string, dst string, proto string, dst_port double, length double, error string")
    kept = stored(read)
    packets = kept.where("error IS NULL").select("seq", F.concat_ws("\x1f", "path", "src").alias("src"), F.concat_ws("\x1f", "path", "dst").alias("dst"), "proto", F.col("dst_port").cast("int").alias("dst_port"), F.col("length").cast("int").alias("length"))
    events = detect.events(packets).withColumn("path", F.split_part("src", F.lit("\x1f"), F.lit(1)))
    plain = lambda c: F.split_part(c, F.lit("\x1f"), F.lit(-1))
    order = F.row_number().over(Window.partitionBy("path").orderBy("order_class", "order_key", "src", "dst")) - 1
    told = F.concat_ws(" ", F.replace("kind", F.lit("_"), F.lit(" ")), plain("src"), plain("dst"))
    rows = events.select("path", order.cast("bigint").alias("row_no"), told.alias("title"), "severity", F.concat(told, F.lit(": "), F.col("amount").cast("string")).alias("description"), plain("src").alias("source_ip"), plain("dst").alias("destination_ip"))
    return rows, kept.where("error IS NOT NULL").select("path", "error")


_CAPTURE = ["path", "seq", "src", "dst", "proto", "dst_port", "length", "error"]
