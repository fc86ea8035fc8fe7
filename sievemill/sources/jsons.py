"""JSON sources: packets, STIX bundles, OSCAL catalogs, mapping tables, exports, and the folder inventory."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemill.functions import fixed, text

FINDING = (
    "id string, severity string, title string, description string, affected_assets array<struct<identifier string, asset_type string, details string>>, raw_excerpt string, cve_ids array<string>, cvss_score double, recommendations array<string>, references array<string>, "
    "source_ip string, destination_ip string, protocol string, timestamp_observed string, metadata struct<nvt_oid string, nvt_title string, ports array<string>, services array<string>, hostnames array<string>, technical_summary string, mitre_mapping struct<mitre_ids array<string>, validation_passed boolean>>"
)
PACKET = f"id string, source_type string, source_file string, source_hash string, timestamp string, report_date string, findings array<struct<{FINDING}>>, finding_count int, critical_count int, high_count int, metadata struct<parser_name string, parser_version string, processed_at string, processing_time_ms int, warnings array<string>, errors array<string>>, document_summary string"
STIX = "type string, id string, name string, description string, revoked boolean, x_mitre_deprecated boolean, x_mitre_platforms array<string>, external_references array<struct<source_name string, external_id string>>, kill_chain_phases array<struct<kill_chain_name string, phase_name string>>, relationship_type string, source_ref string, target_ref string"
FORMATS = {".pdf": "report", ".csv": "csv", ".pcap": "capture", ".pcapng": "capture", ".json": "packet"}


def format_of(path: str) -> str:
    """The format of a file by its suffix; others are an error."""
    suffix = os.path.splitext(path)[1].lower()
    if suffix not in FORMATS:
        raise ValueError(f"no reader for {suffix or 'a file without suffix'}")
    return FORMATS[suffix]


def packets(spark: SparkSession, folder: str, pattern: str = "*.json") -> DataFrame:
    """Packet files with a `path`; unreadable ones are skipped."""
    raw = spark.read.schema(PACKET).option("multiLine", "true").option("mode", "DROPMALFORMED").option("pathGlobFilter", pattern).json(folder)
    return raw.withColumn("path", F.col("_metadata.file_path"))


def packet_findings(packet_rows: DataFrame) -> DataFrame:
    """Findings of packets, flattened, with packet_id and row_no."""
    each = packet_rows.select(F.col("id").alias("packet_id"), F.posexplode("findings").alias("row_no", "f"))
    plain = [c.split()[0] for c in ("severity", "title", "description", "affected_assets", "raw_excerpt", "cve_ids", "cvss_score", "recommendations", "references", "source_ip", "destination_ip", "protocol")]
    meta = ["nvt_oid", "nvt_title", "ports", "services", "hostnames", "technical_summary"]
    return each.select("packet_id", F.col("f.id").alias("finding_id"), "row_no", *[F.col(f"f.{c}").alias(c) for c in plain], text.timestamp_of(F.col("f.timestamp_observed")).alias("timestamp_observed"), *[F.col(f"f.metadata.{c}").alias(c) for c in meta], F.col("f.metadata.mitre_mapping.mitre_ids").alias("mitre_ids"), F.col("f.metadata.mitre_mapping.validation_passed").alias("validation_passed"))


def mapped_findings(packet_rows: DataFrame) -> DataFrame:
    """Findings with a summary and at least one non-blank id: what can be correlated or learned from."""
    ids = F.filter(F.coalesce("mitre_ids", F.array().cast("array<string>")), lambda t: text.safe_str(t) != "")
    return packet_findings(packet_rows).withColumn("mitre_ids", ids).where((text.safe_str("technical_summary") != "") & (F.size("mitre_ids") > 0))


def stix_objects(spark: SparkSession, path: str) -> DataFrame:
    """Objects of a bundle, with `technique_id` of attack patterns."""
    bundle = spark.read.schema(f"objects array<struct<{STIX}>>").option("multiLine", "true").json(path)
    each = bundle.select(F.explode("objects").alias("o")).select("o.*")
    ids = F.filter(F.transform(F.coalesce("external_references", F.array().cast("array<struct<source_name string, external_id string>>")), lambda r: r["external_id"]), lambda t: t.rlike(fixed.TECHNIQUE))
    return each.withColumn("technique_id", F.get(ids, F.lit(0)))


def techniques(objects: DataFrame) -> DataFrame:
    """Live techniques with text: technique_id, name, technical_summary, platforms, tactics."""
    live = objects.where("type = 'attack-pattern' AND NOT coalesce(revoked, false) AND NOT coalesce(x_mitre_deprecated, false) AND technique_id IS NOT NULL")
    body = text.collapse(F.concat_ws(". ", text.blank_to_null("name"), text.blank_to_null("description")))
    return live.select("technique_id", "name", body.alias("technical_summary"), F.col("x_mitre_platforms").alias("platforms"), F.transform("kill_chain_phases", lambda p: p["phase_name"]).alias("tactics")).where("technical_summary <> ''")


def oscal_groups(spark: SparkSession, path: str) -> DataFrame:
    """Groups of a catalog as JSON text in `group`, for `graph.nested_controls`."""
    whole = spark.read.text(path, wholetext=True)
    groups = F.from_json(F.get_json_object("value", "$.catalog.groups"), "array<string>")
    return whole.select(F.explode(groups).alias("group"))


def attack_mapping(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema("mapping_objects array<struct<capability_id string, attack_object_id string, mapping_type string>>").option("multiLine", "true").json(path)
    return rows.select(F.explode("mapping_objects").alias("m")).select("m.*")


def export_rows(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a JSON array of objects under either set of names; other elements are dropped."""
    rows = spark.read.schema("vendor string, vendor_name string, cid string, control_id string, steps string, remediation_steps string, mitre_ids array<string>").option("multiLine", "true").option("mode", "DROPMALFORMED").json(path)
    return rows.select(text.first_filled("vendor", "vendor_name").alias("vendor_name"), text.first_filled("cid", "control_id").alias("control_id"), text.first_filled("steps", "remediation_steps").alias("description"), "mitre_ids").where("control_id IS NOT NULL")


def inventory(spark: SparkSession, folder: str, pattern: str = "*.json") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "length", "modificationTime")


def newest(files: DataFrame) -> DataFrame:
    return files.agg(F.max_by("path", F.struct("modificationTime", "path")).alias("path"))


def file_in(folder: str, name: str) -> str:
    """The path of a file directly in a folder; names that lead elsewhere are an error."""
    base = os.path.realpath(folder)
    path = os.path.realpath(os.path.join(base, name))
    if os.path.dirname(path) != base:
        raise ValueError("the name leaves the folder")
    return path


def hashes(spark: SparkSession, folder: str) -> DataFrame:
    """path and SHA-256 of the content."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", F.sha2("content", 256).alias("source_hash"))


def correlated_files(spark: SparkSession, folder: str) -> DataFrame:
    """Correlated packet files directly in a folder, sorted by path."""
    return inventory(spark, folder, "*_correlated.json").orderBy("path")


def label_corpus(spark: SparkSession, path: str, mapping, allowed: list[str]) -> DataFrame:
    """text1_norm, tags_norm of a JSON-lines corpus under either set of names; rows without text or a good tag go."""
    from sievemill.operators.remap import normal_tags

    rows = spark.read.schema("text string, text1 string, mitre_tags array<string>, labels array<string>").json(path)
    tags = F.coalesce(F.when(F.size("mitre_tags") > 0, F.col("mitre_tags")), F.col("labels"))
    made = rows.select(text.training_text(text.first_filled("text", "text1")).alias("text1_norm"), normal_tags(tags, mapping, allowed).alias("tags_norm"))
    return made.where((F.coalesce("text1_norm", F.lit("")) != "") & (F.size("tags_norm") > 0))
