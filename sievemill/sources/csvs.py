"""CSV exports: alias resolution, row projection into findings."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemill.functions import fixed, text


def normal_name(name: str) -> str:
    """Lower case, stripped, underscores and hyphens as blanks."""
    return re.sub(r"[_-]", " ", name.strip().lower())


def aliases(columns: list[str]) -> dict[str, str]:
    """Logical field -> column; aliases are normalised like the columns. Of columns with one name the last counts."""
    named = {normal_name(c): c for c in columns}
    found = {}
    for logical, names in fixed.CSV_ALIASES.items():
        hit = next((named[normal_name(n)] for n in names if normal_name(n) in named), None)
        if hit:
            found[logical] = hit
    return found


def is_log(fields: dict[str, str]) -> bool:
    return "timestamp" in fields and ("title" in fields or "source_ip" in fields)


def read(spark: SparkSession, path: str | list[str], delimiter: str = ",", encoding: str = "UTF-8") -> DataFrame:
    """All columns as text; rows with too many fields are skipped (DROPMALFORMED counts them as malformed)."""
    return spark.read.csv(path, header=True, sep=delimiter, encoding=encoding, mode="DROPMALFORMED", multiLine=True, escape='"', enforceSchema=False)


def encoding_of(spark: SparkSession, path: str | list[str], first: str | None = None) -> str:
    """The first of `first`, UTF-8 and ISO-8859-1 that reads every line (the last one reads any bytes).

    Lines are tested one by one as they stream from the files, so no file is held in memory. A `first` of another name than
    UTF-8 counts as readable if Python knows it and it decodes every line.
    """
    lines = spark.read.text(path).select(F.col("value").cast("binary").alias("raw"))  # the bytes as they are
    names = dict.fromkeys([*([first] if first else []), "UTF-8"])
    for name in names:
        if name.upper().replace("_", "-") in ("UTF-8", "UTF8"):
            bad = lines.where(~F.is_valid_utf8(F.col("raw").cast("string")))
        else:

            @F.pandas_udf("boolean")
            def broken(raw: pd.Series, _name: str = name) -> pd.Series:
                def fails(b: bytes) -> bool:
                    try:
                        b.decode(_name)
                    except (UnicodeDecodeError, LookupError):
                        return True
                    return False

                return raw.map(fails)

            bad = lines.where(broken("raw"))
        if bad.isEmpty():
            return name
    return "ISO-8859-1"


def findings(rows: DataFrame, file_name: str = "", order: list[str] | None = None, extra: list[str] = ()) -> DataFrame:
    """Findings of a CSV table of any columns; clashing names cannot occur, as only logical fields come out.

    `row_no` counts from 0: by `order` (columns that name a row) if given, else in the order Spark reads the rows. Only
    log tables have addresses, protocol and time; only they name events after them. Columns of `extra` are no fields and
    come out as they are.
    """
    columns = [c for c in rows.columns if c not in extra]
    fields = aliases(columns)
    quoted = {k: F.col(f"`{c}`").cast("string") for k, c in fields.items()}
    missing = F.lit(None).cast("string")
    at = lambda k: text.blank_to_null(quoted[k]) if k in quoted else missing
    shown = [c for c in columns if c != fields.get("title")]
    pairs = [F.when(F.col(f"`{c}`").isNotNull(), F.concat(F.lit(f"{c}: "), text.safe_str(F.col(f"`{c}`").cast("string")))) for c in shown]
    described = F.concat_ws(" | ", *pairs) if pairs else F.lit("")
    everything = F.concat_ws(" | ", *[F.when(F.col(f"`{c}`").isNotNull(), F.concat(F.lit(f"{c}: "), text.safe_str(F.col(f"`{c}`").cast("string")))) for c in columns]) if columns else F.lit("")
    log = is_log(fields)
    named = [(label, quoted[k]) for label, k in (("From", "source_ip"), ("To", "dest_ip"), ("Action", "action")) if k in quoted]
    number = (F.col("_row") + 1).cast("string")
    event = F.concat_ws(" | ", *[F.concat(F.lit(f"{label}: "), text.safe_str(c)) for label, c in named]) if named else F.concat(F.lit("Event "), number)
    title = F.coalesce(at("title"), event if log else missing, F.concat(F.lit("Entry "), number))
    description = F.coalesce(at("description"), described)
    of_log = lambda k: at(k) if log else missing
    assets = F.array_distinct(F.array_compact(F.array(at("host"), at("source_ip"), at("dest_ip"))))
    return counted(rows, order).select(
        F.col("_row").alias("row_no"),
        text.severity_of(at("severity")).alias("severity"),
        F.substring(title, 1, 500).alias("title"),
        F.substring(description, 1, 5000).alias("description"),
        F.transform(assets, lambda a: F.struct(a.alias("identifier"), F.lit("host").alias("asset_type"), F.lit(None).cast("string").alias("details"))).alias("affected_assets"),
        F.substring(everything, 1, 2000).alias("raw_excerpt"),
        F.array_sort(F.array_union(text.cves(description), text.cves(at("cve")))).alias("cve_ids"),
        text.score_of(at("cvss")).alias("cvss_score"),
        of_log("source_ip").alias("source_ip"),
        of_log("dest_ip").alias("destination_ip"),
        of_log("protocol").alias("protocol"),
        text.timestamp_of(of_log("timestamp")).alias("timestamp_observed"),
        F.array_compact(F.array(at("port"))).alias("ports"),
        F.lit(file_name).alias("source_file"),
        *extra,
    )


def counted(rows: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Adds `_row`, counted from 0 over all partitions: one count per partition comes to the driver."""
    from sievemill.operators.state import checkpointed

    laid = rows.repartitionByRange(*order).sortWithinPartitions(*order) if order else rows
    laid = checkpointed(laid).withColumn("_part", F.spark_partition_id()).withColumn("_in", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    counts = {r["_part"]: r["n"] for r in laid.groupBy("_part").agg(F.count("*").alias("n")).collect()}  # a row per partition
    starts, at = [], 0
    for p in sorted(counts):
        starts.append((p, at))
        at += counts[p]
    before = rows.sparkSession.createDataFrame(starts, "_part int, _before long")
    return laid.join(F.broadcast(before), "_part").withColumn("_row", F.col("_before") + F.col("_in")).drop("_part", "_in", "_before")


def summary(rows: DataFrame) -> str:
    names = ", ".join(rows.columns[:10])
    return f"CSV with {rows.count()} rows and {len(rows.columns)} columns: {names}"

