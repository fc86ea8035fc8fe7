"""Queries over findings, packets and mappings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemill.functions import fixed, text
from sievemill.operators import dedup, detect, gates, stats
from sievemill.operators.common import latest, top_n
from sievemill.plans.registry import query, table

LIVE = "live AS (SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY finding_id ORDER BY ingested_at DESC NULLS LAST) AS k FROM findings) WHERE k = 1)"
MAPPED = "mapped AS (SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY mapping_id ORDER BY mapped_at DESC NULLS LAST) AS k FROM mappings) WHERE k = 1)"
FLOWS = (
    f"{LIVE}, flows AS (SELECT finding_id, source_ip AS src, destination_ip AS dst, upper(trim(protocol)) AS proto, try_cast(split_part(ports[1], '/', 1) AS INTEGER) AS dst_port, "
    "length(description)::INTEGER AS length, row_no::BIGINT AS seq FROM live WHERE source_ip IS NOT NULL)"
)


def live(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Findings by their latest delivery, with the named columns (all by default)."""
    rows = table(spark, d, "findings")
    kept = rows.select("finding_id", "ingested_at", *columns) if columns else rows
    return latest(kept, ["finding_id"], [F.col("ingested_at")])


def mapped(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Mappings by their latest delivery, with the named columns (all by default)."""
    rows = table(spark, d, "mappings")
    kept = rows.select("mapping_id", "mapped_at", *columns) if columns else rows
    return latest(kept, ["mapping_id"], [F.col("mapped_at")])


def flows(spark: SparkSession, d: str) -> DataFrame:
    """Network findings as packet rows."""
    port = F.split_part(F.get("ports", F.lit(0)), F.lit("/"), F.lit(1)).try_cast("int")
    return live(spark, d, "ports", "source_ip", "destination_ip", "protocol", "description", "row_no").where("source_ip IS NOT NULL").select("finding_id", F.col("source_ip").alias("src"), F.col("destination_ip").alias("dst"), F.upper(F.trim("protocol")).alias("proto"), port.alias("dst_port"), F.char_length("description").alias("length"), F.col("row_no").cast("bigint").alias("seq"))


@query(f"WITH {LIVE} SELECT packet_id, count(*) AS finding_count, count(*) FILTER (lower(trim(severity)) = 'critical') AS critical_count, count(*) FILTER (lower(trim(severity)) = 'high') AS high_count FROM live GROUP BY 1")
def packet_counts(spark: SparkSession, d: str) -> DataFrame:
    return stats.packet_counts(live(spark, d, "packet_id", "severity"))


@query(
    f"WITH {LIVE}, own AS (SELECT packet_id, count(*) AS n FROM live GROUP BY 1), p AS (SELECT packet_id, arg_max(coalesce(finding_count, -1), coalesce(created_at, TIMESTAMP '0001-01-01')) AS told FROM packets GROUP BY 1) "
    "SELECT p.packet_id, CAST(coalesce(n, 0) AS BIGINT) AS n_findings FROM p LEFT JOIN own USING (packet_id) WHERE told <> coalesce(n, 0)"
)
def stale_packet_counts(spark: SparkSession, d: str) -> DataFrame:
    told = table(spark, d, "packets").groupBy("packet_id").agg(F.max_by(F.coalesce("finding_count", F.lit(-1)), F.coalesce("created_at", F.lit("0001-01-01").cast("timestamp_ntz"))).alias("told"))
    own = live(spark, d, "packet_id").groupBy("packet_id").agg(F.count("*").alias("n"))
    return told.join(own, "packet_id", "left").select("packet_id", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_findings"), "told").where("told <> n_findings").drop("told")


@query(f"WITH {FLOWS} SELECT src, dst, count(*) AS n_packets FROM flows GROUP BY 1, 2")
def flow_counts(spark: SparkSession, d: str) -> DataFrame:
    return detect.flow_counts(flows(spark, d))


@query(f"WITH {FLOWS} SELECT src, count(DISTINCT dst_port) AS n_ports, list_sort(array_agg(DISTINCT dst_port) FILTER (dst_port IS NOT NULL))[1:10] AS sample FROM flows WHERE proto IN ('TCP', 'UDP') GROUP BY 1 HAVING count(DISTINCT dst_port) >= 2")
def port_scans(spark: SparkSession, d: str) -> DataFrame:
    return detect.port_scans(flows(spark, d), least=2)


@query(f"WITH {FLOWS} SELECT CASE WHEN proto IN ('TCP', 'UDP', 'ICMP') THEN proto ELSE 'Other' END AS protocol, count(*) AS n_packets FROM flows GROUP BY 1")
def protocol_counts(spark: SparkSession, d: str) -> DataFrame:
    return detect.protocol_counts(flows(spark, d))


_PORTS = ", ".join(str(p) for p in fixed.SUSPICIOUS_PORTS)


@query(f"WITH {FLOWS} SELECT finding_id, src, dst, dst_port FROM flows WHERE proto = 'TCP' AND dst_port IN ({_PORTS})")
def suspicious_ports(spark: SparkSession, d: str) -> DataFrame:
    return detect.suspicious_ports(flows(spark, d)).select("finding_id", "src", "dst", "dst_port")


@query(
    f"WITH {FLOWS}, pairs AS (SELECT DISTINCT src, dst_port FROM flows WHERE proto IN ('TCP', 'UDP')) SELECT kind, severity, count(*) AS n_events, sum(amount)::BIGINT AS amount FROM ("
    f"SELECT 'suspicious_port' AS kind, 'medium' AS severity, 1 AS amount FROM flows WHERE proto = 'TCP' AND dst_port IN ({_PORTS}) "
    "UNION ALL SELECT 'large_dns_query', 'low', length FROM flows WHERE proto = 'UDP' AND dst_port = 53 AND length > 512 "
    "UNION ALL SELECT 'port_scan', 'high', count(dst_port) FROM pairs GROUP BY src HAVING count(dst_port) >= 2 "
    "UNION ALL SELECT 'connection_flood', 'medium', count(*) FROM flows GROUP BY src, dst HAVING count(*) >= 2) GROUP BY 1, 2"
)
def anomaly_events(spark: SparkSession, d: str) -> DataFrame:
    found = detect.events(flows(spark, d), scan_ports=2, flood_packets=2)
    return found.groupBy("kind", "severity").agg(F.count("*").alias("n_events"), F.sum("amount").alias("amount"))


@query(f"WITH {FLOWS} SELECT count(*) AS packets, count(DISTINCT src) AS sources, count(DISTINCT dst) AS destinations, (SELECT count(*) FROM flows WHERE proto = 'TCP' AND dst_port IN ({_PORTS})) AS events FROM flows")
def capture_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = flows(spark, d)
    return detect.capture_summary(rows, detect.suspicious_ports(rows))


_BANDS = "CASE WHEN s >= 9 THEN 'critical' WHEN s >= 7 THEN 'high' WHEN s >= 4 THEN 'medium' WHEN s >= 0.1 THEN 'low' ELSE 'info' END"


@query(
    f"WITH {LIVE}, c AS (SELECT lower(trim(severity)) AS t, try_cast(cvss_score AS VARCHAR) AS u, cvss_score AS s FROM live) SELECT CASE WHEN t IS NULL THEN 'unknown' WHEN t LIKE '%critical%' THEN 'critical' WHEN t LIKE '%high%' THEN 'high' WHEN t LIKE '%medium%' THEN 'medium' WHEN t LIKE '%low%' THEN 'low' "
    f"WHEN t LIKE '%info%' THEN 'info' ELSE 'unknown' END AS told, CASE WHEN s IS NULL THEN 'unknown' ELSE {_BANDS} END AS scored, count(*) AS n_findings FROM c GROUP BY 1, 2"
)
def severity_agreement(spark: SparkSession, d: str) -> DataFrame:
    rows = live(spark, d, "severity", "cvss_score").select(text.severity_of("severity").alias("told"), text.severity_of(F.col("cvss_score").cast("string")).alias("scored"))
    return rows.groupBy("told", "scored").agg(F.count("*").alias("n_findings"))


@query(rf"WITH {MAPPED} SELECT mapping_id, list_sort(list_distinct(regexp_extract_all(finding_summary, '(?i)CVE-\d{{4}}-\d{{4,}}'))) AS cves FROM mapped WHERE len(regexp_extract_all(finding_summary, '(?i)CVE-\d{{4}}-\d{{4,}}')) > 0")
def text_cves(spark: SparkSession, d: str) -> DataFrame:
    return mapped(spark, d, "finding_summary").select("mapping_id", text.cves("finding_summary").alias("cves")).where(F.size("cves") > 0)


@query(
    f"WITH {LIVE} SELECT p.parser AS parser, count(*) AS n_findings, count(*) FILTER (lower(trim(severity)) = 'critical') AS n_critical, round(avg((cvss_score IS NOT NULL)::INTEGER), 6) AS score_share, "
    "(SELECT count(DISTINCT upper(trim(v))) FROM (SELECT unnest(cve_ids) AS v, packet_id FROM live) x JOIN (SELECT packet_id, any_value(coalesce(parser_metadata.parser_name, 'unknown')) AS q FROM packets GROUP BY 1) y USING (packet_id) WHERE y.q = p.parser) AS n_cves "
    "FROM live JOIN (SELECT packet_id, any_value(coalesce(parser_metadata.parser_name, 'unknown')) AS parser FROM packets GROUP BY 1) p USING (packet_id) GROUP BY 1"
)
def parser_comparison(spark: SparkSession, d: str) -> DataFrame:
    parser = table(spark, d, "packets").groupBy("packet_id").agg(F.any_value(F.coalesce("parser_metadata.parser_name", F.lit("unknown"))).alias("parser"))
    made = stats.parser_comparison(live(spark, d, "packet_id", "severity", "cvss_score", "cve_ids", "affected_assets").join(parser, "packet_id"), "parser")
    return made.select("parser", "n_findings", "n_critical", F.round("score_share", 6).alias("score_share"), "n_cves")


@query("WITH one AS (SELECT DISTINCT packet_id, source_type, parser_metadata.processing_time_ms AS ms FROM packets) SELECT source_type, count(ms) AS n, round(avg(ms), 2) AS mean, round(quantile_cont(ms, 0.95), 2) AS p95, round(max(ms)::DOUBLE, 2) AS maximum FROM one GROUP BY 1")
def parse_timing(spark: SparkSession, d: str) -> DataFrame:
    one = table(spark, d, "packets").select("packet_id", "source_type", F.col("parser_metadata.processing_time_ms").cast("double").alias("ms")).distinct()
    return stats.timing(one, "ms", ["source_type"])


_PLAIN = (
    "trim(regexp_replace(regexp_replace(coalesce(title, ''), '(?i)\\s*\\(CVSS:\\s*[^)]+\\)\\s*$', ''), '[\\s\\x{a0}]+', ' ', 'g'))"
)


@query(f"WITH {LIVE} SELECT finding_id, {_PLAIN} AS title FROM live")
def normal_titles(spark: SparkSession, d: str) -> DataFrame:
    return live(spark, d, "title").select("finding_id", text.title_without_score("title").alias("title"))


@query(f"WITH {MAPPED} SELECT count(*) FILTER (validation_passed) AS n_valid, count(*) FILTER (NOT validation_passed) AS n_failed, count(*) FILTER (coalesce(len(mitre_ids), 0) = 0) AS n_empty, count(*) AS n_rows FROM mapped")
def mapping_review(spark: SparkSession, d: str) -> DataFrame:
    return stats.mapping_review(mapped(spark, d, "mitre_ids", "validation_passed"))


_IDS = r"list_distinct(list_filter(list_transform(mitre_ids, lambda x: upper(trim(x))), lambda x: regexp_matches(x, '^T\d{4}(\.\d{3})?$')))"


@query(f"WITH {MAPPED} SELECT t AS technique_id, count(*) AS n_rows FROM (SELECT unnest({_IDS}) AS t FROM mapped) GROUP BY 1")
def id_frequency(spark: SparkSession, d: str) -> DataFrame:
    return stats.id_frequency(mapped(spark, d, "mitre_ids"))


@query(
    f"WITH {MAPPED}, f AS (SELECT mapping_id, unnest({_IDS}) AS t FROM mapped), k AS (SELECT mapping_id, count(*) AS n, count(*) FILTER (split_part(t, '.', 1) IN (SELECT technique_id FROM label_targets) OR t IN (SELECT technique_id FROM label_targets)) AS good FROM f GROUP BY 1) "
    "SELECT mapping_id, good::BIGINT AS n_known, (n - good)::BIGINT AS n_unknown FROM k"
)
def known_ids(spark: SparkSession, d: str) -> DataFrame:
    ids = mapped(spark, d, "mitre_ids").select("mapping_id", F.explode(text.normal_ids("mitre_ids")).alias("t"))
    registry = gates.registry_ids(table(spark, d, "label_targets"), "technique_id")
    return ids.groupBy("mapping_id").agg(F.count_if(gates.known(F.col("t"), registry)).alias("n_known"), F.count_if(~gates.known(F.col("t"), registry)).alias("n_unknown"))


_UP = "list_transform(coalesce(mitre_ids, []), lambda x: upper(trim(x)))"
_REG = "(SELECT list(technique_id) FROM label_targets)"
_KEPT = f"list_filter({_UP}, lambda x, i: regexp_matches(x, '^T\\d{{4}}(\\.\\d{{3}})?$') AND (list_contains(reg, x) OR list_contains(reg, split_part(x, '.', 1))) AND list_position({_UP}, x) = i)"
_C2 = r"regexp_matches(coalesce(finding_summary, ''), '(?i)\b(c2|command and control|command-and-control|beacon|callback|dead drop|drop resolver|dns tunnel|covert channel|ingress tool|steganograph|covert comms|exfiltration channel)\b')"


@query(f"WITH {MAPPED}, r AS (SELECT mapping_id, finding_summary, mitre_ids, {_REG} AS reg FROM mapped), g AS (SELECT mapping_id, {_C2} AS c2, {_KEPT} AS ids FROM r), h AS (SELECT mapping_id, CASE WHEN c2 THEN ids ELSE list_filter(ids, lambda x: split_part(x, '.', 1) <> 'T1102') END AS ids FROM g) SELECT mapping_id, ids[1:5] AS accepted FROM h")
def gate_accepted(spark: SparkSession, d: str) -> DataFrame:
    registry = gates.registry_ids(table(spark, d, "label_targets"), "technique_id")
    return gates.validate(mapped(spark, d, "mitre_ids", "finding_summary"), "mitre_ids", "finding_summary", registry, fallback=False).select("mapping_id", "accepted")


@query(f"WITH {MAPPED} SELECT mapping_id, list_distinct(list_transform(regexp_extract_all(split_part(coalesce(raw_model_output, ''), ']', 1), '(?i)\\bT\\d{{4}}(?:\\.\\d{{3}})?\\b'), lambda x: upper(x))) AS ids_unordered FROM mapped".replace("ids_unordered", "ids").replace("list_distinct(", "list_sort(list_distinct(").replace("upper(x)))", "upper(x))))"))
def answer_ids(spark: SparkSession, d: str) -> DataFrame:
    return mapped(spark, d, "raw_model_output").select("mapping_id", F.array_sort(text.technique_ids("raw_model_output")).alias("ids"))


@query(
    "SELECT report_id, finding_id FROM (SELECT *, row_number() OVER (PARTITION BY trim(regexp_replace(coalesce(technical_summary, ''), '\\s+', ' ', 'g')), list_sort(list_distinct(list_filter(list_transform(coalesce(mitre_ids, []), lambda x: upper(trim(x))), lambda x: regexp_matches(x, '^T\\d{4}(\\.\\d{3})?$')))) "
    "ORDER BY (source_name = 'production_mapped') DESC NULLS LAST, report_id) AS k FROM (SELECT DISTINCT * FROM reports) WHERE trim(coalesce(technical_summary, '')) <> '' AND len(list_filter(list_transform(coalesce(mitre_ids, []), lambda x: upper(trim(x))), lambda x: regexp_matches(x, '^T\\d{4}(\\.\\d{3})?$'))) > 0) WHERE k = 1"
)
def seed_dedup(spark: SparkSession, d: str) -> DataFrame:
    local = F.coalesce(F.col("source_name") == "production_mapped", F.lit(False))
    return dedup.seed_records(table(spark, d, "reports"), summary="technical_summary", ids="mitre_ids", local=local, order=[F.col("report_id")]).select("report_id", "finding_id")


@query(f"WITH {LIVE} SELECT packet_id, finding_id, rank::INTEGER AS rank FROM (SELECT packet_id, finding_id, row_number() OVER (PARTITION BY packet_id ORDER BY row_no, finding_id) AS rank FROM live) WHERE rank <= 3")
def first_findings(spark: SparkSession, d: str) -> DataFrame:
    return top_n(live(spark, d, "packet_id", "row_no").select("packet_id", "finding_id", "row_no"), ["packet_id"], [F.col("row_no"), F.col("finding_id")], 3).select("packet_id", "finding_id", "rank")


@query(
    f"WITH {LIVE}, {MAPPED}, pairs AS (SELECT DISTINCT finding_id, t AS technique_id FROM (SELECT finding_id, unnest({_IDS}) AS t FROM mapped)), done AS (SELECT DISTINCT finding_id FROM live WHERE len(recommendations) > 0), "
    "n AS (SELECT technique_id, count(*) AS n_findings, count(done.finding_id) AS n_remediated FROM pairs LEFT JOIN done USING (finding_id) GROUP BY 1), cells AS (SELECT DISTINCT technique_id FROM label_targets), "
    "u AS (SELECT technique_id, 'catalog' AS tactic, coalesce(n_findings, 0) AS n_findings, coalesce(n_remediated, 0) AS n_remediated FROM cells LEFT JOIN n USING (technique_id) UNION ALL SELECT technique_id, 'Unmapped', n_findings, n_remediated FROM n WHERE technique_id NOT IN (SELECT technique_id FROM cells)) "
    "SELECT *, CASE WHEN n_findings = 0 THEN 'neutral' WHEN n_findings = n_remediated THEN 'green' ELSE 'red' END AS state FROM u"
)
def technique_coverage(spark: SparkSession, d: str) -> DataFrame:
    pairs = mapped(spark, d, "finding_id", "mitre_ids").select("finding_id", F.explode(text.normal_ids("mitre_ids")).alias("technique_id"))
    done = live(spark, d, "recommendations").where(F.size("recommendations") > 0).select("finding_id")
    catalog = table(spark, d, "label_targets").select("technique_id", F.lit("catalog").alias("tactic"))
    return stats.coverage(catalog, pairs, done)


@query(
    r"WITH v AS (SELECT 'ip' AS pattern, unnest(regexp_extract_all(text, '\b(?:\d{1,3}\.){3}\d{1,3}\b')) AS value FROM documents UNION ALL SELECT 'cve', unnest(regexp_extract_all(text, '(?i)CVE-\d{4}-\d{4,}')) FROM documents "
    r"UNION ALL SELECT 'port', unnest(regexp_extract_all(text, '(?i)(\d+)/(?:TCP|UDP)', 1)) FROM documents) SELECT pattern, count(*) AS n_matches, count(DISTINCT value) AS n_values FROM v GROUP BY 1"
)
def text_patterns(spark: SparkSession, d: str) -> DataFrame:
    return stats.pattern_profile(table(spark, d, "documents"), "text")
