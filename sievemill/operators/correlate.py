"""Composite-scored correlation of findings with controls, and the rerankings.

Candidates come from the vector top-k, so the joins below run on at most k rows per finding.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievemill.functions import fixed, text
from sievemill.operators.common import top_n


def _of_candidates(edges: DataFrame, candidates: DataFrame) -> DataFrame:
    """Edges of the controls among the candidates; their ids are at most k per finding, and the optimizer picks the join."""
    return edges.join(candidates.select("control_id").distinct(), "control_id", "left_semi")


def structural_match(candidates: DataFrame, mitigates: DataFrame) -> DataFrame:
    """Adds `matched_mitre`: the control's techniques that are among the finding's `mitre_ids`, sorted.

    Only edges of the candidates' controls are aggregated, per control before the join, so candidates are never widened.
    """
    per_control = _of_candidates(mitigates, candidates).groupBy("control_id").agg(F.collect_set("technique_id").alias("_techniques"))
    joined = candidates.join(per_control, "control_id", "left")
    return joined.withColumn("matched_mitre", F.array_sort(F.coalesce(F.array_intersect("_techniques", "mitre_ids"), F.array().cast("array<string>")))).drop("_techniques")


def vendor_match(candidates: DataFrame, provides: DataFrame, allowed: list[str]) -> DataFrame:
    """Adds `vendor` (smallest name) and `vendor_matched`: any vendor equals or holds an allowed name."""
    per_control = _of_candidates(provides, candidates).groupBy("control_id").agg(F.array_sort(F.collect_set("vendor_name")).alias("_vendors"))
    names = F.array(*[F.lit(a) for a in allowed]) if allowed else F.array().cast("array<string>")
    joined = candidates.join(per_control, "control_id", "left").withColumn("_vendors", F.coalesce("_vendors", F.array().cast("array<string>")))
    hit = F.exists("_vendors", lambda v: F.exists(names, lambda a: F.contains(F.lower(v), a)))
    return joined.withColumn("vendor", F.get("_vendors", F.lit(0))).withColumn("vendor_matched", hit).drop("_vendors")


def composite_score(framework: str | None = None) -> Column:
    asked = F.size("mitre_ids")
    share = F.when(asked > 0, F.lit(fixed.MITRE_BOOST) * F.size("matched_mitre") / asked).otherwise(0.0)
    special = F.col("vendor").isNotNull() & ((F.col("vendor") != framework) if framework else F.lit(True))
    return F.col("similarity") + share + F.when(F.col("vendor_matched"), fixed.VENDOR_BOOST).otherwise(0.0) + F.when(special, fixed.SPECIFICITY_BONUS).otherwise(0.0)


def composite_top_n(candidates: DataFrame, mitigates: DataFrame, provides: DataFrame, *, allowed: list[str], n: int = fixed.TOP_N, framework: str | None = None) -> DataFrame:
    """Top n candidates (finding_id, control_id, similarity, mitre_ids) per finding by composite score, ties by control."""
    scored = vendor_match(structural_match(candidates, mitigates), provides, [a.strip().lower() for a in allowed if a.strip()]).withColumn("score", composite_score(framework))
    return top_n(scored, ["finding_id"], [F.desc("score"), F.col("control_id")], n)


def keyword_rerank(ranked: DataFrame, finding_tokens: str, control_tokens: str) -> DataFrame:
    """Adds `reranked`: candidates without a common word lose a penalty; a finding without words keeps its order."""
    lone = (F.size(finding_tokens) > 0) & ~F.arrays_overlap(finding_tokens, control_tokens)
    lowered = ranked.withColumn("adjusted", F.col("score") - F.when(F.coalesce(lone, F.lit(False)), fixed.RELEVANCE_PENALTY).otherwise(0.0))
    return top_n(lowered, ["finding_id"], [F.desc("adjusted"), F.col("rank")], 2**31 - 1, "reranked")


def example_rerank(pool: DataFrame, *, summary: str = "summary", labels: str = "labels", keep: int = 1) -> DataFrame:
    """Reranks a pool (query, similarity, rank, labels) by tactic agreement and keeps the best.

    Each label whose tactics meet the summary's tactics adds a bonus; each T1102 without C2 evidence costs a penalty.
    """
    tactics = text.technique_tactics()
    agreeing = F.size(F.filter(labels, lambda t: F.coalesce(F.arrays_overlap(tactics[text.root(t)], F.col("_present")), F.lit(False))))
    web = F.when(text.has_c2_evidence(summary), F.lit(0)).otherwise(F.size(F.filter(labels, lambda t: text.root(t) == "T1102")))
    scored = pool.withColumn("_present", text.tactics_in(summary)).withColumn("adjusted", F.col("similarity") + fixed.TACTIC_BONUS * agreeing - fixed.C2_PENALTY * web).drop("_present")
    return top_n(scored, ["query_id"], [F.desc("adjusted"), F.col("rank")], keep, "reranked")


def split_by_vendor(candidates: DataFrame, framework: str) -> tuple[DataFrame, DataFrame]:
    """Vendor candidates and framework candidates; one without a vendor belongs to the framework."""
    other = F.col("vendor").isNotNull() & (F.col("vendor") != framework)
    return candidates.where(other), candidates.where(~other)


def knn_vote(neighbours: DataFrame, label: str, truth_key: str = "query_id") -> DataFrame:
    """The labels of each query's neighbours by summed similarity, best first, ties by label."""
    votes = neighbours.groupBy(truth_key, label).agg(F.sum("similarity").alias("votes"))
    return top_n(votes, [truth_key], [F.desc("votes"), F.col(label)], 1).drop("rank")
