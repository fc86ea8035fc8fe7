"""Stage 4: remediation of correlated findings, verified and generated again where it fails."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievemill.functions import render, text
from sievemill.functions.models import Generator, Judge, generated, judged
from sievemill.operators import verify

CONTROL = "struct<control_id string, vendor_product string, remediation_steps string, audit_procedure string>"


def remediable(correlated: DataFrame) -> DataFrame:
    """Findings with a correlation (`best` control) and a summary with text."""
    return correlated.where(F.col("best").isNotNull() & (text.safe_str("technical_summary") != ""))


def correlated(ranked: DataFrame, controls: DataFrame, findings: DataFrame, framework: str | None = None) -> DataFrame:
    """One row per finding: its summary, ids, the best control and the other candidates by vendor and framework, in order.

    `ranked` is (finding_id, control_id, vendor, vendor_matched, similarity, score, reranked, mitre_ids), n rows a finding.
    """
    shape = F.struct("control_id", F.col("vendor").alias("vendor_product"), F.coalesce("description", F.lit("")).alias("remediation_steps"), F.lit(None).cast("string").alias("audit_procedure"))
    other = F.col("vendor").isNotNull() & ((F.col("vendor") != framework) if framework else F.lit(True))
    full = ranked.join(controls.select("control_id", "description"), "control_id", "left").withColumn("c", F.struct("reranked", shape.alias("control"), other.alias("of_vendor"), "similarity", "score", "vendor_matched"))
    grouped = full.groupBy("finding_id").agg(F.array_sort(F.collect_list("c")).alias("all"), F.first("mitre_ids").alias("mitre_ids"))  # n rows a group
    side = lambda kept: F.transform(F.filter("all", kept), lambda x: x["control"])
    made = grouped.select(
        "finding_id", "mitre_ids", F.get("all", F.lit(0))["control"].alias("best"), side(lambda x: x["of_vendor"]).alias("vendor_controls"), side(lambda x: ~x["of_vendor"]).alias("framework_controls"),
        *[F.get("all", F.lit(0))[c].alias(c) for c in ("similarity", "score", "vendor_matched")],
    )
    return findings.select("finding_id", "technical_summary", "severity").join(made, "finding_id", "left")


def prompt(stack: list[str]) -> Column:
    """Summary, severity, techniques, systems and the controls."""
    ids = F.coalesce(F.nullif(F.array_join("mitre_ids", ", "), F.lit("")), F.lit("none"))
    return F.concat(F.col("technical_summary"), F.lit("\nSeverity: "), F.coalesce("severity", F.lit("medium")), F.lit("\nTechniques: "), ids, F.lit(f"\nSystems: {', '.join(stack)}\n\n"), F.col("source"))


def remediate(rows: DataFrame, generator: Generator, *, judge: Judge | None = None, stack: list[str] = (), retries: int = 2, searched: Column | None = None) -> DataFrame:
    """Adds `output`, scores, `passed`, `issues` and `attempts` to remediable findings.

    `searched` marks findings that were looked up beyond the graph; their outputs may name limitations instead of controls.
    """
    none = F.array().cast("array<string>")
    ids = lambda c: F.transform(F.coalesce(c, F.array().cast(f"array<{CONTROL}>")), lambda x: x["control_id"])
    ready = remediable(rows).withColumn("source", render.controls_text("best", "vendor_controls", "framework_controls")).withColumn("prompt", prompt(list(stack))).withColumn("searched", searched if searched is not None else F.lit(False))

    def check(made: DataFrame) -> DataFrame:
        flat = made.withColumn("steps", F.coalesce("output.steps", F.array().cast(_STEPS))).withColumn("best_id", F.col("best.control_id")).withColumn("vendor_ids", ids("vendor_controls")).withColumn("framework_ids", ids("framework_controls")).withColumn("references", F.coalesce("output.source_control_ids", none))
        score = None
        if judge is not None:
            flat = judged(flat, judge, F.transform("steps", verify.step_text), "source")
            score = verify.judged("verdicts")
        lifted = F.col("searched") & (F.size(F.coalesce("output.limitations", none)) > 0)
        told = verify.verdict(flat.drop("issues"), summary="technical_summary", best="best_id", judge=score, lifted=lifted)
        return told.drop("steps", "best_id", "vendor_ids", "framework_ids", "references", "verdicts")

    return verify.retried(ready, lambda todo, attempt: generated(todo, generator), check, retries).drop("source", "prompt")


_STEPS = "array<struct<step_number int, title string, command_or_action string, explanation string, vendor_product string, step_type string, ui_breadcrumb string, substeps array<string>, evidence_tier string, supporting_urls array<string>>>"


def metadata(remediated: DataFrame, *, model: str, prompt_version: str) -> DataFrame:
    """finding_id and `remediation`: the output with its provenance and verification, as one struct."""
    out = lambda c: F.col(f"output.{c}").alias(c)
    provenance = F.struct(F.when(F.col("searched"), "graph_plus_search").otherwise("graph_only").alias("mode"))
    checked = F.struct(F.col("grounding").alias("grounding_score"), F.col("relevance").alias("relevance_score"), F.col("completeness").alias("completeness_score"), F.col("substep_quality").alias("substep_quality_score"), "passed", "issues", "attempts")
    made = F.struct(*[out(c) for c in ("executive_summary", "limitations", "steps", "priority", "estimated_effort", "prerequisites")], F.col("output.verification").alias("verification_procedure"), out("source_control_ids"), provenance.alias("provenance"), F.lit(model).alias("model"), F.lit(prompt_version).alias("prompt_version"), F.current_timestamp().alias("generated_at"), checked.alias("selfrag_verification"))
    return remediated.select("finding_id", made.alias("remediation"))


def remember(state: DataFrame, remediated: DataFrame) -> DataFrame:
    """The table of remediated findings (finding_id, version): those that passed, with a version one above the state's for new ones."""
    top = state.agg(F.coalesce(F.max("version"), F.lit(0)).alias("top"))
    fresh = remediated.where("passed").select("finding_id").distinct().join(state.select("finding_id"), "finding_id", "left_anti")
    return state.select("finding_id", "version").unionByName(fresh.crossJoin(F.broadcast(top)).select("finding_id", (F.col("top") + 1).cast("int").alias("version")))  # one row


def file_name(stem: str, stamp: str) -> str:
    """Name of a remediated packet file: without `_correlated`, with a UTC stamp."""
    return f"{stem.removesuffix('_correlated')}_remediated_{stamp}.json"
