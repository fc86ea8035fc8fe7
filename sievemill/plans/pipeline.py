"""The stages as one application: DataFrames hand over to each other, nothing is parsed back from output."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemill.functions import render, text
from sievemill.functions.models import Embedder, Generator, Judge, Labeller, Summarizer, embedded, summarized
from sievemill.functions.models import labelled as labelled_by
from sievemill.operators import correlate, gates, vectors
from sievemill.operators.common import latest
from sievemill.operators.state import stored
from sievemill.plans import remediation
from sievemill.sources import folders


@dataclass
class Stages:
    summaries: DataFrame
    labelled: DataFrame
    candidates: DataFrame
    remediated: DataFrame | None = None


def live_findings(findings: DataFrame) -> DataFrame:
    """One row per finding, the delivery latest by `ingested_at`, with text of some kind."""
    one = latest(findings, ["finding_id"], [F.col("ingested_at")])
    return one.where((text.safe_str("title") != "") | (text.safe_str("description") != ""))


def live_mappings(mapped: DataFrame) -> DataFrame:
    """finding_id, mitre_ids (and mapping_id): the latest delivery of every mapping, or, of rows without ids, equal ones once."""
    if {"mapping_id", "mapped_at"} <= set(mapped.columns):
        one = latest(mapped.where("mapping_id IS NOT NULL"), ["mapping_id"], [F.col("mapped_at")])
        return one.select("finding_id", "mitre_ids", "mapping_id")
    return mapped.select("finding_id", "mitre_ids").distinct()


def run(findings: DataFrame, mapped: DataFrame, registry: DataFrame, controls: DataFrame, provides: DataFrame, mitigates: DataFrame, *, embedder: Embedder, allowed: list[str], summarizer: Summarizer | None = None, generator: Generator | None = None, judge: Judge | None = None, cache: DataFrame | None = None, retries: int = 2, k: int = 100, n: int = 5) -> Stages:
    """Summaries, validated labels, correlated controls and, with a generator, verified remediation of the findings.

    `mapped` is finding_id, mitre_ids and, to tell repeated deliveries, mapping_id, mapped_at; `controls` is control_no (a number), control_id, description; `registry` is
    technique_id. Findings and controls join through numbers, as vectors do not travel with texts. Each mapping passes the
    gates by itself (`labelled` has a row per mapping); a finding is searched once, with all ids accepted for it.
    """
    known = live_findings(findings)
    told = summarized(known, summarizer, cache=cache).select("finding_id", "technical_summary", "summary_source", "cache_key")
    asked = told.join(live_mappings(mapped), "finding_id", "left")
    labelled = gates.validate(asked, "mitre_ids", "technical_summary", gates.registry_ids(registry, "technique_id"))
    wanted = labelled.where((F.size("accepted") > 0) & (text.safe_str("technical_summary") != ""))
    united = wanted.groupBy("finding_id", "technical_summary").agg(F.array_distinct(F.flatten(F.sort_array(F.collect_list("accepted")))).alias("mitre_ids"))  # after the gates, whose limit is per mapping
    query = render.query_text("technical_summary", "mitre_ids")
    keyed = united.select("finding_id", F.xxhash64("finding_id").alias("finding_no"), "mitre_ids", "technical_summary", query.alias("query"))
    near = vectors.top_k(embedded(keyed, "query", "vector", embedder), embedded(controls, "description", "vector", embedder), k, query_key="finding_no", item_key="control_no", query_vector="vector", item_vector="vector")
    pool = near.join(keyed.drop("query"), "finding_no").join(controls.select("control_no", "control_id", "description"), "control_no").select("finding_id", "control_id", "similarity", "mitre_ids", "technical_summary", "description")
    best = correlate.composite_top_n(pool, mitigates, provides, allowed=allowed, n=n)
    ranked = correlate.keyword_rerank(best.withColumn("_f", text.tokens("technical_summary")).withColumn("_c", text.tokens(F.concat_ws(" ", "description", "control_id"))), "_f", "_c").drop("_f", "_c", "technical_summary", "description")
    if generator is None:
        return Stages(told, labelled, ranked)
    severity = F.col("severity") if "severity" in known.columns else F.lit(None).cast("string")
    rows = remediation.correlated(ranked, controls, told.join(known.select("finding_id", severity.alias("severity")), "finding_id"))
    return Stages(told, labelled, ranked, remediation.remediate(rows, generator, judge=judge, stack=allowed, retries=retries))


def run_folder(spark: SparkSession, folder: str, labeller: Labeller, registry: DataFrame, controls: DataFrame, provides: DataFrame, mitigates: DataFrame, *, extract: Callable[[bytes], list[str]] | None = None, recursive: bool = False, **options) -> tuple[folders.Folder, Stages]:
    """From the files of a folder to remediated findings: ingest, summaries, labels by the model, gates, correlation, generation."""
    read = folders.ingest(spark, folder, recursive=recursive, extract=extract)
    needed = {"cve_ids": "array<string>", "services": "array<string>", "severity": "string"}
    rows = read.findings
    for name, kind in needed.items():
        rows = rows if name in rows.columns else rows.withColumn(name, F.lit(None).cast(kind))
    rows = stored(rows.select("finding_id", "title", "description", "severity", "cve_ids", "services").withColumn("ingested_at", F.lit(None).cast("timestamp_ntz")))
    prompts = summarized(live_findings(rows), None).withColumn("prompt", F.concat_ws("\n", "technical_summary", "description"))
    mapped = stored(labelled_by(prompts, labeller).select("finding_id", "mitre_ids"))
    return read, run(rows, mapped, registry, controls, provides, mitigates, **options)
