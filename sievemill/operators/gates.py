"""Validation gates over proposed technique ids, as array expressions: no explode, no shuffle.

Issues are `struct<gate, severity, message, technique_id>` in gate order. The registry is a list of ids, which the plan
holds as a hash set; a registry past its bound goes through `known_by_join`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievemill.functions import fixed, text

ISSUE = "struct<gate string, severity string, message string, technique_id string>"
NO_IDS = "array<string>"


def _none() -> Column:
    return F.array().cast(f"array<{ISSUE}>")


def _issue(gate: str, severity: str, message: Column, technique: Column) -> Column:
    return F.struct(F.lit(gate).alias("gate"), F.lit(severity).alias("severity"), message.alias("message"), technique.alias("technique_id"))


def known(t: Column, registry: list) -> Column:
    """Whether the registry holds the id or its root: a look-up in a hash set, not a walk through a list."""
    if not registry:
        return t.isNull() & F.lit(False)
    return t.isin(registry) | F.split_part(t, F.lit("."), F.lit(1)).isin(registry)


def known_by_join(df: DataFrame, ident: str, ids: str, registry: DataFrame, key: str) -> DataFrame:
    """`ident`, `known_ids`: those of `ids` that a registry table of any size holds by id or root, sorted; joins by id."""
    held = registry.select(F.upper(key).alias("_r")).where("_r IS NOT NULL").distinct()
    each = df.select(ident, F.explode(F.array_distinct(ids)).alias("_t")).where("_t IS NOT NULL")
    asked = each.select("_t").distinct()
    good = asked.join(held, asked["_t"] == held["_r"], "left_semi").union(asked.join(held, text.root(asked["_t"]) == held["_r"], "left_semi")).distinct()
    kept = each.join(good, "_t").groupBy(ident).agg(F.array_sort(F.collect_set("_t")).alias("known_ids"))
    return df.select(ident).distinct().join(kept, ident, "left").withColumn("known_ids", F.coalesce("known_ids", F.array().cast(NO_IDS)))


def format_gate(ids: Column, registry: list) -> tuple[Column, Column]:
    """Accepted ids (upper case, right form, in the registry by id or root, distinct in order) and issues."""
    upper = F.transform(F.coalesce(ids, F.array().cast(NO_IDS)), lambda t: F.upper(text.strip(t)))
    right = lambda t: F.coalesce(t.rlike(fixed.TECHNIQUE), F.lit(False))
    accepted = F.array_distinct(F.filter(upper, lambda t: right(t) & known(t, registry)))
    malformed = F.transform(F.filter(upper, lambda t: ~right(t)), lambda t: _issue("format", "error", F.lit("not a technique id"), t))
    unknown = F.transform(F.filter(upper, lambda t: right(t) & ~known(t, registry)), lambda t: _issue("format", "error", F.lit("id is not in the registry"), t))
    return accepted, F.concat(malformed, unknown)


def semantic_gate(ids: Column, summary: Column) -> tuple[Column, Column, Column]:
    """Without explicit C2 evidence T1102 and its children go; kept ids, issues and whether one was removed."""
    web = lambda t: text.root(t) == "T1102"
    proof = text.has_c2_evidence(summary)
    kept = F.when(proof, ids).otherwise(F.filter(ids, lambda t: ~web(t)))
    removed = F.when(proof, F.array().cast(NO_IDS)).otherwise(F.filter(ids, web))
    return kept, F.transform(removed, lambda t: _issue("semantic", "warning", F.lit("no evidence of command and control"), t)), F.size(removed) > 0


def consistency_gate(accepted: Column, candidates: Column, present: Column) -> Column:
    """Advisory issues for ids none of whose tactics is `present` (`text.tactics_in` of the summary, computed once: `text.bound`).

    Candidates are checked if no id was accepted.
    """
    ids = F.when(F.size(accepted) > 0, accepted).otherwise(candidates)
    tactics = text.technique_tactics()
    odd = F.filter(ids, lambda t: tactics[text.root(t)].isNotNull() & ~F.arrays_overlap(tactics[text.root(t)], present))
    return F.transform(odd, lambda t: _issue("consistency", "warning", F.lit("no word of its tactics in the summary"), t))


def policy_gate(ids: Column, most: int = fixed.MAX_TECHNIQUES) -> tuple[Column, Column, Column]:
    over = F.size(ids) > most
    issue = F.when(over, F.array(_issue("policy", "error", F.lit("too many techniques"), F.lit(None).cast("string")))).otherwise(_none())
    return F.slice(ids, 1, most), issue, ~over


def validate(df: DataFrame, ids: str, summary: str, registry: list[str], *, fallback: bool = True) -> DataFrame:
    """Adds `accepted`, `issues`, `issue_count` and `passed` (format, semantic and policy; consistency only advises)."""
    shown, told = F.col(ids), F.col(summary)
    proposed = F.coalesce(shown, F.array().cast(NO_IDS))
    first, wrong = format_gate(shown, [F.lit(t) for t in registry])  # each literal made once
    step = df.withColumn("_format", first).withColumn("_wrong", wrong)
    kept, dropped, removed = semantic_gate(F.col("_format"), told)
    step = step.withColumn("_kept", kept).withColumn("_dropped", dropped).withColumn("_removed", removed)
    entry = F.lit("T1190")
    inject = F.lit(fallback) & (F.size("_kept") == 0) & F.col("_removed") & text.has_initial_access(told) & F.lit("T1190" in registry)
    step = step.withColumn("_injected", inject).withColumn("_ids", F.when(F.col("_injected"), F.array(entry)).otherwise(F.col("_kept")))
    note = F.when(F.col("_injected"), F.array(_issue("semantic", "info", F.lit("replaced by the public-facing technique"), entry))).otherwise(_none())
    candidates = F.transform(proposed, lambda t: F.upper(text.strip(t)))
    doubts = text.bound(text.tactics_in(told), lambda present: consistency_gate(F.col("_ids"), candidates, present))
    cut, over, within = policy_gate(F.col("_ids"))
    step = step.withColumn("accepted", cut).withColumn("issues", F.concat("_wrong", "_dropped", note, doubts, over))
    step = step.withColumn("issue_count", F.size("issues")).withColumn("passed", (F.size("_wrong") == 0) & within)
    return step.drop("_format", "_wrong", "_kept", "_dropped", "_removed", "_injected", "_ids")


def lost_all_to_semantics(candidates: str, accepted: str, issues: str) -> Column:
    return (F.size(candidates) > 0) & (F.size(accepted) == 0) & F.exists(issues, lambda i: i["gate"] == "semantic")


def training_rows(validated: DataFrame, ids: str, summary: str) -> DataFrame:
    """Rows fit for training: passed, 1 to 5 accepted ids, not emptied by semantics, a summary with text."""
    return validated.where(F.col("passed") & F.size("accepted").between(1, fixed.MAX_TECHNIQUES) & ~lost_all_to_semantics(ids, "accepted", "issues") & (text.safe_str(summary) != ""))


def registry_ids(techniques: DataFrame, key: str, most: int = 20_000) -> list[str]:
    """The ids of a registry table, upper case and sorted; more than `most` are an error (`known_by_join` takes any number)."""
    rows = techniques.select(F.upper(key).alias("t")).where("t IS NOT NULL").distinct().orderBy("t").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"the registry holds more than {most} ids; use known_by_join")
    return [r.t for r in rows]


def bundle_ids(objects: DataFrame) -> DataFrame:
    """Allow-list from STIX rows: the distinct technique ids of attack patterns that are neither revoked nor deprecated."""
    live = objects.where("type = 'attack-pattern' AND NOT coalesce(revoked, false) AND NOT coalesce(x_mitre_deprecated, false) AND technique_id IS NOT NULL")
    return live.select(F.upper("technique_id").alias("technique_id")).distinct()
