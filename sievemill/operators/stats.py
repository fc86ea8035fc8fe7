"""Aggregates over packets, findings, timings, mappings and technique coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemill.functions import fixed, text
from sievemill.operators.common import keep_first, small


def packet_counts(findings: DataFrame) -> DataFrame:
    sev = F.lower(F.trim("severity"))
    return findings.groupBy("packet_id").agg(F.count("*").alias("finding_count"), F.count_if(sev == "critical").alias("critical_count"), F.count_if(sev == "high").alias("high_count"))


def timing(df: DataFrame, value: str, group: list[str] | None = None) -> DataFrame:
    """Count, mean, 95th percentile (linear between ranks) and maximum, rounded to 2 places."""
    return df.groupBy(*(group or [])).agg(F.count(value).alias("n"), F.round(F.avg(value), 2).alias("mean"), F.round(F.percentile(value, 0.95), 2).alias("p95"), F.round(F.max(value), 2).alias("maximum"))


def stage_timing(df: DataFrame, value: str, stages: list[str], group: list[str] | None = None) -> DataFrame:
    """`timing` with the mean of each stage column as `mean_<stage>`."""
    means = [F.round(F.avg(c), 2).alias(f"mean_{c}") for c in stages]
    return df.groupBy(*(group or [])).agg(F.count(value).alias("n"), F.round(F.avg(value), 2).alias("mean"), F.round(F.percentile(value, 0.95), 2).alias("p95"), F.round(F.max(value), 2).alias("maximum"), *means)


def common_ports(pages: DataFrame, value: str, n: int = 20) -> DataFrame:
    """The n ports named most often in all texts."""
    each = pages.select(F.explode(F.regexp_extract_all(F.coalesce(value, F.lit("")), F.lit(fixed.PORT), F.lit(1))).alias("port"))
    return each.groupBy("port").agg(F.count("*").alias("n_rows")).orderBy(F.desc("n_rows"), "port").limit(n)


def technique_catalog(spark: SparkSession) -> DataFrame:
    """The techniques known with their tactics, as catalog rows (tactic, technique_id)."""
    return spark.createDataFrame([(tactic, t) for t, tactics in fixed.TECHNIQUE_TACTICS.items() for tactic in tactics], "tactic string, technique_id string")


def summary_stats(findings: DataFrame) -> DataFrame:
    """Findings with and without a usable summary."""
    good = text.valid_summary("technical_summary")
    return findings.agg(F.count_if(good).alias("n_valid"), F.count_if(~F.coalesce(good, F.lit(False))).alias("n_other"))


def mapping_review(mappings: DataFrame) -> DataFrame:
    """Mapped rows: passed, failed, without ids."""
    empty = F.coalesce(F.size("mitre_ids"), F.lit(0)) <= 0
    return mappings.agg(F.count_if("validation_passed").alias("n_valid"), F.count_if(~F.col("validation_passed")).alias("n_failed"), F.count_if(empty).alias("n_empty"), F.count("*").alias("n_rows"))


def id_frequency(mappings: DataFrame) -> DataFrame:
    ids = F.explode(text.normal_ids("mitre_ids"))
    return mappings.select(ids.alias("technique_id")).groupBy("technique_id").agg(F.count("*").alias("n_rows"))


def parser_comparison(findings: DataFrame, parser: str) -> DataFrame:
    """Per parser: findings by severity, distinct CVE ids, share with a score, distinct assets.

    Distinct counts are made per (parser, value) first, so the arrays never meet in one group.
    """
    base = findings.groupBy(parser).agg(F.count("*").alias("n_findings"), *[F.count_if(F.lower(F.trim("severity")) == s).alias(f"n_{s}") for s in fixed.SEVERITIES], F.avg(F.col("cvss_score").isNotNull().cast("int")).alias("score_share"))
    cve = findings.select(parser, F.explode("cve_ids").alias("v")).where("v IS NOT NULL").select(parser, F.upper(F.trim("v")).alias("v")).distinct().groupBy(parser).agg(F.count("*").alias("n_cves"))
    asset = findings.select(parser, F.explode("affected_assets.identifier").alias("v")).where("v IS NOT NULL").distinct().groupBy(parser).agg(F.count("*").alias("n_assets"))
    return base.join(cve, parser, "left").join(asset, parser, "left").fillna(0, ["n_cves", "n_assets"])


def pattern_profile(pages: DataFrame, value: str) -> DataFrame:
    """Per pattern: matches and distinct values in all pages."""
    patterns = {"cve": (fixed.CVE, 0), "ip": (fixed.IPV4, 0), "oid": (fixed.OID, 1), "port": (fixed.PORT, 1), "cvss": (fixed.CVSS_TEXT, 1)}

    def matches(name: str, pattern: str, group: int) -> Column:
        return F.transform(F.regexp_extract_all(F.coalesce(value, F.lit("")), F.lit(pattern), F.lit(group)), lambda v: F.struct(F.lit(name).alias("pattern"), v.alias("value")))

    found = F.concat(*[matches(n, p, g) for n, (p, g) in patterns.items()])
    per_value = pages.select(F.explode(found).alias("m")).groupBy("m.pattern", "m.value").agg(F.count("*").alias("n"))
    return per_value.groupBy("pattern").agg(F.sum("n").alias("n_matches"), F.count("*").alias("n_values"))


def coverage(catalog: DataFrame, mapped: DataFrame, remediated: DataFrame) -> DataFrame:
    """technique_id, tactic, findings, remediated findings and state of every catalog cell.

    `mapped` is (finding_id, technique_id), `remediated` is (finding_id). `neutral` has no finding, `green` has all
    remediated, else `red`. Mapped ids outside the catalog follow under the tactic `Unmapped`.
    """
    pairs = mapped.select("finding_id", "technique_id").distinct()
    done = remediated.select("finding_id").distinct().withColumn("_done", F.lit(True))
    counts = pairs.join(done, "finding_id", "left").groupBy("technique_id").agg(F.count("*").alias("n_findings"), F.count("_done").alias("n_remediated"))
    cells = catalog.select("technique_id", "tactic").distinct()
    listed = cells.join(counts, "technique_id", "left")
    orphan = counts.join(cells.select("technique_id").distinct(), "technique_id", "left_anti").withColumn("tactic", F.lit("Unmapped"))
    made = listed.unionByName(orphan).fillna(0, ["n_findings", "n_remediated"])
    state = F.when(F.col("n_findings") == 0, "neutral").when(F.col("n_findings") == F.col("n_remediated"), "green").otherwise("red")
    return made.withColumn("state", state)


def by_tactic(cells: DataFrame, order: list[str]) -> DataFrame:
    """tactic, place, technique_ids (sorted); tactics outside the order come after it by name."""
    place = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(t) for t in order]), F.col("tactic")).cast("int"), F.lit(0)), F.lit(len(order) + 1))
    return cells.groupBy("tactic").agg(F.array_sort(F.collect_set("technique_id")).alias("technique_ids")).withColumn("place", place)


def catalog_union(*catalogs: DataFrame) -> DataFrame:
    """Catalog rows (tactic, technique_id, name); an earlier catalog's row wins."""
    made = None
    for i, c in enumerate(catalogs):
        part = c.withColumn("_from", F.lit(i))
        made = part if made is None else made.unionByName(part, allowMissingColumns=True)
    return keep_first(made, ["tactic", "technique_id"], [F.col("_from")]).drop("_from")


def readiness(collection: DataFrame | None, vector: str, dim: int, least: int) -> str:
    """`ready`, or the first reason why a vector collection is not: missing, empty, too few, wrong size."""
    if collection is None:
        return "missing"
    row = collection.agg(F.count("*").alias("n"), F.count_if(F.coalesce(F.size(vector), F.lit(-1)) != dim).alias("bad")).first()
    return "empty" if not row.n else "too few" if row.n < least else "wrong size" if row.bad else "ready"


def technique_findings(mapped: DataFrame) -> DataFrame:
    """technique_id, finding_id of every mapped finding, each pair once, with n_findings of the technique.

    Rows rather than one list per technique, as a hot technique may hold a third of all findings.
    """
    pairs = mapped.select("technique_id", "finding_id").distinct()
    return pairs.join(pairs.groupBy("technique_id").agg(F.count("*").alias("n_findings")), "technique_id")


def run_stats(findings: DataFrame, mapped: DataFrame) -> DataFrame:
    """Findings that could be mapped (with a summary), that were, and those skipped for want of a summary."""
    good = text.safe_str("technical_summary") != ""
    done = mapped.select("finding_id").distinct().withColumn("_done", F.lit(True))
    joined = findings.join(done, "finding_id", "left")
    return joined.agg(F.count("*").alias("n_findings"), F.count_if(good & F.col("_done").isNotNull()).alias("n_mapped"), F.count_if(~good).alias("n_skipped"))
