"""Queries over texts: report sections, extraction, normalisation, rendering, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemill.functions import fixed, render, text
from sievemill.operators import dedup, gates, remap
from sievemill.plans.findings import LIVE, MAPPED, live, mapped
from sievemill.plans.registry import query, table
from sievemill.sources import reports


def _words(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _any(x: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({x}, '{w}')" for w in words) + ")"


def _ordered(x: str, families: list[tuple[str, list[str]]]) -> str:
    return "CASE " + " ".join(f"WHEN {_any(x, words)} THEN '{name}'" for name, words in families) + " ELSE 'unknown' END"


_TEXT = "upper(trim(severity)) || ' (CVSS: ' || cvss_score::VARCHAR || ')' || chr(10) || 'NVT: ' || nvt_title || ' (OID: 1.3.6.1.4.1.25623.1.' || row_no || ')' || chr(10) || coalesce(array_to_string(ports, ' '), '') || chr(10) || coalesce(array_to_string(services, ' '), '') || chr(10) || replace(coalesce(array_to_string(hostnames, ' '), ''), '.example', '.internal') || ' ' || coalesce(source_ip, '') || ' ' || coalesce(destination_ip, '') || chr(10) || coalesce(title, '') || ' ' || coalesce(description, '') || chr(10)"
_TOLD = f"{LIVE}, told AS (SELECT packet_id, row_no, finding_id, {_TEXT} AS t FROM live WHERE lower(trim(severity)) IN ('critical', 'high', 'medium', 'low') AND cvss_score IS NOT NULL AND nvt_title IS NOT NULL)"


def report_texts(spark: SparkSession, d: str) -> DataFrame:
    """packet_id, row_no, finding_id and the report section of each finding that has a title, a score and a severity."""
    rows = live(spark, d).where("lower(trim(severity)) IN ('critical', 'high', 'medium', 'low') AND cvss_score IS NOT NULL AND nvt_title IS NOT NULL")
    listed = lambda c: F.coalesce(F.array_join(c, " "), F.lit(""))
    filled = lambda c: F.coalesce(c, F.lit(""))
    lit = F.lit
    t = F.concat(
        F.upper(F.trim("severity")), lit(" (CVSS: "), F.col("cvss_score").cast("string"), lit(")\nNVT: "), F.col("nvt_title"), lit(" (OID: 1.3.6.1.4.1.25623.1."), F.col("row_no").cast("string"), lit(")\n"), listed("ports"), lit("\n"), listed("services"), lit("\n"),
        F.replace(listed("hostnames"), lit(".example"), lit(".internal")), lit(" "), filled("source_ip"), lit(" "), filled("destination_ip"), lit("\n"), filled("title"), lit(" "), filled("description"), lit("\n"),
    )
    return rows.select("packet_id", "row_no", "finding_id", t.alias("t"))


_IP = "list_sort(list_distinct(list_filter(regexp_extract_all(t, '" + fixed.IPV4 + "'), lambda x: try_cast(split_part(x, '.', 1) AS INTEGER) BETWEEN 2 AND 254)))"


@query(
    f"WITH {_TOLD} SELECT finding_id, {_IP} AS ips, list_sort(list_distinct(list_filter(regexp_extract_all(t, '{fixed.PORT}', 1), lambda x: try_cast(x AS BIGINT) BETWEEN 1 AND 65535))) AS ports, "
    f"list_filter({_words([w.upper() for w in fixed.SERVICE_WORDS])}, lambda w: contains(lower(t), lower(w))) AS services, list_sort(list_distinct(regexp_extract_all(lower(t), '{fixed.HOSTNAME}'))) AS hostnames FROM told"
)
def report_network(spark: SparkSession, d: str) -> DataFrame:
    return report_texts(spark, d).select("finding_id", F.array_sort(text.ips("t")).alias("ips"), F.array_sort(text.ports("t")).alias("ports"), text.services("t").alias("services"), F.array_sort(text.hostnames("t")).alias("hostnames"))


_SCORE = f"try_cast(nullif(regexp_extract(t, '{fixed.CVSS_TEXT}', 1), '') AS DOUBLE)"
_OID = f"nullif(regexp_extract(t, '{fixed.OID}', 1), '')"
_NVT = f"nullif(trim(regexp_extract(t, '{fixed.NVT_TITLE}', 1)), '')"


@query(f"WITH {_TOLD} SELECT finding_id, {_SCORE} AS score, {_OID} AS oid, {_NVT} AS nvt_title, {_ordered('lower(t)', fixed.SEVERITY_TEXT_WORDS)} AS severity, list_sort(list_distinct(regexp_extract_all(t, '{fixed.CVE}'))) AS cves FROM told")
def report_scores(spark: SparkSession, d: str) -> DataFrame:
    return report_texts(spark, d).select("finding_id", text.cvss_in_text("t").alias("score"), text.oid("t").alias("oid"), text.nvt_title("t").alias("nvt_title"), text.severity_in_text("t").alias("severity"), text.cves("t").alias("cves"))


@query(f"WITH {_TOLD} SELECT packet_id AS doc_id, (row_number() OVER (PARTITION BY packet_id ORDER BY row_no, finding_id) - 1)::INTEGER AS row_no, {_ordered('lower(split_part(t, chr(10), 1))', fixed.SEVERITY_TEXT_WORDS)} AS severity, {_NVT} AS title, {_SCORE} AS cvss_score, {_OID} AS nvt_oid FROM told")
def report_sections(spark: SparkSession, d: str) -> DataFrame:
    """Findings of whole packet reports, cut at their section headers."""
    rows = report_texts(spark, d)
    docs = rows.groupBy("packet_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_no", "finding_id", "t"))), lambda s: s["t"]), "").alias("body"))  # a report is one file
    return reports.findings(docs, "packet_id", "body").select("doc_id", "row_no", "severity", "title", "cvss_score", "nvt_oid")


@query(f"WITH {LIVE} SELECT finding_id, {_ordered('lower(coalesce(severity, $$$$))', fixed.SEVERITY_TEXT_WORDS)} AS attribute, coalesce(nullif(trim(title), ''), 'none') AS title, CASE WHEN cvss_score >= 0 AND cvss_score <= 10 THEN cvss_score END AS score, timestamp_observed AS observed FROM live")
def typed_cells(spark: SparkSession, d: str) -> DataFrame:
    """Cells as CSV text, read back."""
    title = F.coalesce(text.blank_to_null("title"), F.lit("none"))
    rows = live(spark, d).select("finding_id", "severity", "title", F.col("cvss_score").cast("string").alias("s"), F.replace(F.col("timestamp_observed").cast("string"), F.lit(" "), F.lit("T")).alias("o"))
    return rows.select("finding_id", text.severity_of_attribute("severity").alias("attribute"), title.alias("title"), text.score_of("s").alias("score"), text.timestamp_of("o").alias("observed"))


@query(f"WITH {LIVE} SELECT finding_id, list_filter(list_transform(string_split(array_to_string(services, ' , ') || ', ,x', ','), lambda x: trim(x)), lambda x: x <> '') AS parts FROM live")
def split_lists(spark: SparkSession, d: str) -> DataFrame:
    return live(spark, d).select("finding_id", text.split_list(F.concat(F.array_join("services", " , "), F.when(F.col("services").isNotNull(), F.lit(", ,x")))).alias("parts"))


_WS = r"[\s\x{a0}]+"


def _clean(x: str) -> str:
    collapsed = f"trim(regexp_replace(coalesce({x}, ''), '{_WS}', ' ', 'g'))"
    return rf"trim(regexp_replace(regexp_replace({collapsed}, '\s+([,.;:])', '\1', 'g'), '([.?!]){{2,}}', '\1', 'g'))"


_BANNED = " OR ".join(f"regexp_matches(s, '(?i){p}')" for p in fixed.BANNED_SUMMARY)
_BARE = "s"
for _p in fixed.SUMMARY_NOISE:
    _BARE = f"regexp_replace({_BARE}, '{_p}', '', 'g')"
_VALID = f"(s <> '' AND len(string_split(s, ' ')) BETWEEN {fixed.SUMMARY_WORDS[0]} AND {fixed.SUMMARY_WORDS[1]} AND s LIKE '%.' AND len(regexp_extract_all({_BARE}, '[.!?](?:\\s|$)')) <= {fixed.SUMMARY_ENDS} AND NOT ({_BANNED}))"


@query(f"WITH {MAPPED}, c AS (SELECT mapping_id, {_clean('finding_summary')} AS s FROM mapped) SELECT mapping_id, s AS summary, {_VALID} AS is_valid FROM c")
def clean_summaries(spark: SparkSession, d: str) -> DataFrame:
    return mapped(spark, d).select("mapping_id", text.clean_summary("finding_summary").alias("summary"), F.coalesce(text.valid_summary("finding_summary"), F.lit(False)).alias("is_valid"))


_NAME = r"trim(regexp_replace(regexp_replace(coalesce(title, ''), '(?i)\s*\(CVSS:\s*[^)]+\)\s*$', ''), '" + _WS + "', ' ', 'g'))"


@query(
    f"WITH {LIVE}, p AS (SELECT finding_id, {_NAME} AS name, nullif(trim(cve_ids[1]), '') AS cve, nullif(trim(services[1]), '') AS service FROM live), "
    "q AS (SELECT finding_id, CASE WHEN cve IS NOT NULL AND service IS NOT NULL THEN name || ' affects the ' || service || ' service and is associated with ' || cve || '.' WHEN cve IS NOT NULL THEN name || ' is associated with ' || cve || '.' WHEN service IS NOT NULL THEN name || ' affects the ' || service || ' service.' "
    f"WHEN name <> '' THEN name || ' affects the target system.' ELSE '{fixed.PLAIN_NOTHING}' END AS raw FROM p), c AS (SELECT finding_id, {_clean('raw')} AS s FROM q) SELECT finding_id, s AS technical_summary, {_VALID} AS is_valid FROM c"
)
def plain_summaries(spark: SparkSession, d: str) -> DataFrame:
    made = live(spark, d).select("finding_id", text.plain_summary("title", "cve_ids", "services").alias("technical_summary"))
    return made.withColumn("is_valid", text.valid_summary("technical_summary"))


@query(f"WITH {LIVE} SELECT finding_id, CASE WHEN coalesce(raw_excerpt, '') <> '' THEN raw_excerpt[1:2500] ELSE coalesce(description, '')[1:1000] END AS evidence, coalesce(nullif(array_to_string(cve_ids, ', '), ''), 'N/A') AS cves, CASE WHEN length(description) > 80 THEN regexp_replace(description[1:79], '\\s+$', '') || '…' ELSE description END AS shown FROM live")
def evidence_rows(spark: SparkSession, d: str) -> DataFrame:
    return live(spark, d).select("finding_id", text.evidence("raw_excerpt", "description").alias("evidence"), text.joined_or("cve_ids", "N/A").alias("cves"), text.truncate("description", 80).alias("shown"))


_UPPER = "list_transform(list_filter(coalesce(mitre_ids, []), lambda x: x IS NOT NULL), lambda x: upper(trim(x)))"


@query(f"WITH {MAPPED} SELECT mapping_id, '{fixed.QUERY_HEAD}' || coalesce(finding_summary, '') || CASE WHEN len({_UPPER}) > 0 THEN '{fixed.QUERY_IDS}' || array_to_string({_UPPER}, ', ') || '.' ELSE '' END AS query FROM mapped")
def query_texts(spark: SparkSession, d: str) -> DataFrame:
    ids = F.transform(F.filter(F.coalesce("mitre_ids", F.array().cast("array<string>")), lambda t: t.isNotNull()), lambda t: F.upper(F.trim(t)))
    return mapped(spark, d).withColumn("ids", ids).select("mapping_id", render.query_text("finding_summary", "ids").alias("query"))


def _tokens(x: str, pattern: str, stop: list[str]) -> str:
    return f"list_filter(list_distinct(regexp_extract_all(lower(coalesce({x}, '')), '{pattern}')), lambda w: len(w) > 2 AND NOT list_contains({_words(stop)}, w))"


@query(f"WITH {MAPPED} SELECT mapping_id, list_sort({_tokens('finding_summary', '[a-z0-9]+', fixed.STOPWORDS)}) AS words, list_sort({_tokens('finding_summary', '[a-z0-9' + chr(92) * 2 + '/.]+', fixed.STEP_STOPWORDS)}) AS step_words FROM mapped")
def summary_words(spark: SparkSession, d: str) -> DataFrame:
    summary = F.coalesce("finding_summary", F.lit(""))
    return mapped(spark, d).select("mapping_id", F.array_sort(text.tokens(summary)).alias("words"), F.array_sort(text.step_tokens(summary)).alias("step_words"))


@query(r"SELECT report_id, t AS training_text FROM (SELECT report_id, regexp_replace(trim(regexp_replace(coalesce(s, ''), '[\s\x{a0}]+', ' ', 'g')), '(?i)^(?:technical[ _]summary|summary|finding|description)\s*:\s*', '') AS t FROM (SELECT report_id, max(CASE WHEN report_id % 2 = 0 THEN 'Summary:  ' || technical_summary ELSE technical_summary END) AS s FROM reports GROUP BY 1))")
def training_texts(spark: SparkSession, d: str) -> DataFrame:
    labelled = F.when(F.col("report_id") % 2 == 0, F.concat(F.lit("Summary:  "), F.col("technical_summary"))).otherwise(F.col("technical_summary"))
    rows = table(spark, d, "reports").groupBy("report_id").agg(F.max(labelled).alias("s"))
    return rows.select("report_id", text.training_text("s").alias("training_text"))


@query("SELECT p_partkey, 'AC-' || lpad((p_partkey % 40 + 1)::VARCHAR, 2, '0') || CASE WHEN p_size % 3 = 0 THEN '.' || p_size ELSE '' END AS key, 'Set [ASSIGNMENT] for ' || trim(p_name) AS body FROM part")
def control_keys(spark: SparkSession, d: str) -> DataFrame:
    raw = F.concat(F.lit(" ac-"), (F.col("p_partkey") % 40 + 1).cast("string"), F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("."), F.col("p_size").cast("string"))).otherwise(F.lit("")))
    body = F.concat(F.lit("Set {{ insert: param, x }}  for\n"), F.col("p_name"))
    return table(spark, d, "part").select("p_partkey", text.control_key(raw).alias("key"), text.without_placeholders(body).alias("body"))


@query("SELECT s_suppkey, ('fw-' || regexp_replace(regexp_replace(lower(s_name), '[^a-z0-9_]+', '-', 'g'), '^-+|-+$', '', 'g'))[1:48] AS slug, 'ctl-' || sha256(s_name || chr(0) || s_suppkey)[1:24] AS node, least(s_name, 'M') || chr(0) || greatest(s_name, 'M') AS edge FROM supplier")
def graph_ids(spark: SparkSession, d: str) -> DataFrame:
    from sievemill.operators import graph

    rows = table(spark, d, "supplier").withColumn("m", F.lit("M"))
    return rows.select("s_suppkey", text.slug("s_name").alias("slug"), text.node_id(F.col("s_name"), F.col("s_suppkey").cast("string")).alias("node"), graph.undirected_key("s_name", "m").alias("edge"))


@query(f"WITH {MAPPED} SELECT mapping_id, {_UPPER} AS ids, '[' || array_to_string(list_transform({_UPPER}, lambda t: '''' || t || ''''), ', ') || ']' AS literal FROM mapped")
def list_literals(spark: SparkSession, d: str) -> DataFrame:
    ids = F.transform(F.filter(F.coalesce("mitre_ids", F.array().cast("array<string>")), lambda t: t.isNotNull()), lambda t: F.upper(F.trim(t)))
    return mapped(spark, d).select("mapping_id", text.list_literal(ids).alias("literal")).select("mapping_id", text.parse_literal("literal").alias("ids"), "literal")


_TACTICS = "list_filter([" + ", ".join(f"CASE WHEN {_any('low', words)} THEN '{t}' END" for t, words in fixed.TACTIC_WORDS.items()) + "], lambda x: x IS NOT NULL)"
_C2 = f"regexp_matches(coalesce(finding_summary, ''), '{fixed.C2_EVIDENCE}')"


@query(f"WITH {MAPPED}, l AS (SELECT mapping_id, finding_summary, lower(coalesce(finding_summary, '')) AS low FROM mapped) SELECT mapping_id, {_TACTICS} AS tactics, {_C2} AS c2, {_any('low', fixed.TACTIC_WORDS['initial-access'])} AS entry FROM l")
def summary_tactics(spark: SparkSession, d: str) -> DataFrame:
    return mapped(spark, d).select("mapping_id", text.tactics_in("finding_summary").alias("tactics"), text.has_c2_evidence("finding_summary").alias("c2"), text.has_initial_access("finding_summary").alias("entry"))


_FORM = r"^T\d{{4}}(\.\d{{3}})?$".replace("{{", "{").replace("}}", "}")
_TT = "MAP {" + ", ".join(f"'{k}': {_words(v)}" for k, v in fixed.TECHNIQUE_TACTICS.items()) + "}"
_KNOWN = "(list_contains(reg, {x}) OR list_contains(reg, split_part({x}, '.', 1)))"
VALIDATED = (
    f"{MAPPED}, r AS (SELECT mapping_id, finding_summary, lower(coalesce(finding_summary, '')) AS low, list_transform(coalesce(mitre_ids, []), lambda x: upper(trim(x))) AS up, (SELECT list(technique_id) FROM label_targets) AS reg FROM mapped), "
    f"a AS (SELECT *, {_C2} AS c2, list_filter(up, lambda x: coalesce(regexp_matches(x, '{_FORM}'), false)) AS formed, len(list_filter(up, lambda x: NOT coalesce(regexp_matches(x, '{_FORM}'), false))) AS n_bad FROM r), "
    f"b AS (SELECT *, list_filter(formed, lambda x, i: {_KNOWN.format(x='x')} AND list_position(formed, x) = i) AS fmt, len(list_filter(formed, lambda x: NOT {_KNOWN.format(x='x')})) AS n_unknown FROM a), "
    "c AS (SELECT *, CASE WHEN c2 THEN fmt ELSE list_filter(fmt, lambda x: split_part(x, '.', 1) <> 'T1102') END AS kept FROM b), "
    f"e AS (SELECT *, len(fmt) - len(kept) AS n_lost, (len(kept) = 0 AND len(fmt) > 0 AND list_contains(reg, 'T1190') AND {_any('low', fixed.TACTIC_WORDS['initial-access'])}) AS injected FROM c), "
    f"g AS (SELECT *, CASE WHEN injected THEN ['T1190'] ELSE kept END AS ids, {_TACTICS} AS present FROM e), "
    f"h AS (SELECT *, {_TT} AS tt, CASE WHEN len(ids) > 0 THEN ids ELSE up END AS asked FROM g), "
    "v AS (SELECT mapping_id, finding_summary, up, ids[1:5] AS accepted, n_bad + n_unknown = 0 AND len(ids) <= 5 AS passed, n_lost, "
    "n_bad + n_unknown + n_lost + injected::INTEGER + (len(ids) > 5)::INTEGER + len(list_filter(asked, lambda x: tt[split_part(x, '.', 1)] IS NOT NULL AND NOT list_has_any(tt[split_part(x, '.', 1)], present))) AS issue_count FROM h)"
)


def validated(spark: SparkSession, d: str) -> DataFrame:
    registry = gates.registry_ids(table(spark, d, "label_targets"), "technique_id")
    return gates.validate(mapped(spark, d, "mitre_ids", "finding_summary"), "mitre_ids", "finding_summary", registry)


@query(f"WITH {VALIDATED} SELECT mapping_id, accepted, passed, issue_count::INTEGER AS issue_count FROM v")
def validated_mappings(spark: SparkSession, d: str) -> DataFrame:
    return validated(spark, d).select("mapping_id", "accepted", "passed", "issue_count")


@query(f"WITH {VALIDATED} SELECT mapping_id FROM v WHERE passed AND len(accepted) BETWEEN 1 AND 5 AND trim(coalesce(finding_summary, '')) <> ''")
def training_mappings(spark: SparkSession, d: str) -> DataFrame:
    return gates.training_rows(validated(spark, d), "mitre_ids", "finding_summary").select("mapping_id")


@query(f"WITH {VALIDATED} SELECT count(*) FILTER (len(up) > 0 AND len(accepted) = 0 AND n_lost > 0) AS n_lost, count(*) AS n_rows FROM v")
def lost_to_semantics(spark: SparkSession, d: str) -> DataFrame:
    rows = validated(spark, d)
    return rows.agg(F.count_if(gates.lost_all_to_semantics("mitre_ids", "accepted", "issues")).alias("n_lost"), F.count("*").alias("n_rows"))


_MAP = "CASE {x} WHEN 'T1200' THEN 'T1557' WHEN 'T1599' THEN 'T1557' END"
_REMAP = f"coalesce({_MAP.format(x='x')}, {_MAP.format(x=chr(115) + 'plit_part(x, ' + chr(39) + '.' + chr(39) + ', 1)')}, x)"


@query(
    f"WITH {MAPPED}, r AS (SELECT mapping_id, list_transform(list_transform(coalesce(mitre_ids, []), lambda x: upper(trim(x))), lambda x: {_REMAP}) AS ids, (SELECT list(technique_id) FROM label_targets) AS reg FROM mapped), "
    f"g AS (SELECT mapping_id, list_filter(ids, lambda x: coalesce(x[1] = 'T', false) AND {_KNOWN.format(x='x')}) AS good FROM r), u AS (SELECT mapping_id, list_filter(good, lambda x, i: list_position(good, x) = i)[1:5] AS good FROM g) "
    "SELECT mapping_id, list_transform(list_sort(list_transform(good, lambda x: {r: split_part(x, '.', 1), t: x})), lambda s: s.t) AS tags FROM u"
)
def remapped_ids(spark: SparkSession, d: str) -> DataFrame:
    """Tags through a chain of two deprecations and a self-map."""
    pairs = spark.createDataFrame([("T1599", "T1557"), ("T1200", "T1599"), ("T1602", "T1602")], "old string, new string").where("old <> new")
    allowed = gates.registry_ids(table(spark, d, "label_targets"), "technique_id")
    return mapped(spark, d, "mitre_ids").select("mapping_id", remap.normal_tags("mitre_ids", remap.map_column(pairs), allowed).alias("tags"))


_OBJECTS = "SELECT 'T1' || lpad(n_nationkey::VARCHAR, 3, '0') AS old, 'T1' || lpad(n_regionkey::VARCHAR, 3, '0') AS new FROM nation"


@query(f"WITH o AS ({_OBJECTS}) SELECT DISTINCT old, new FROM o WHERE old <> new")
def deprecated_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Nations as techniques that were revoked by the one with their region's number."""
    nation = table(spark, d, "nation")
    none = F.lit(None).cast("string")
    number = lambda c: F.concat(F.lit("T1"), F.lpad(F.col(c).cast("string"), 3, "0"))
    patterns = nation.select(F.lit("attack-pattern").alias("type"), F.concat(F.lit("ap-"), F.col("n_nationkey").cast("string")).alias("id"), number("n_nationkey").alias("technique_id"), none.alias("relationship_type"), none.alias("source_ref"), none.alias("target_ref"))
    revoked = nation.select(F.lit("relationship").alias("type"), none.alias("id"), none.alias("technique_id"), F.lit("revoked-by").alias("relationship_type"), F.concat(F.lit("ap-"), F.col("n_nationkey").cast("string")).alias("source_ref"), F.concat(F.lit("ap-"), F.col("n_regionkey").cast("string")).alias("target_ref"))
    return remap.deprecations(patterns.unionByName(revoked))


@query(f"WITH {MAPPED}, t AS (SELECT DISTINCT mapping_id, unnest({_UPPER}) AS t FROM mapped), k AS (SELECT technique_id FROM label_targets) SELECT mapping_id, t AS technique_id FROM t WHERE t IN (FROM k) OR split_part(t, '.', 1) IN (FROM k)")
def allowed_ids(spark: SparkSession, d: str) -> DataFrame:
    each = mapped(spark, d, "mitre_ids").select("mapping_id", F.explode("mitre_ids").alias("t")).where("t IS NOT NULL").select("mapping_id", F.upper(F.trim("t")).alias("technique_id")).distinct()
    return remap.allowed_rows(each, "technique_id", table(spark, d, "label_targets"), "technique_id").select("mapping_id", "technique_id")


@query(f"WITH {MAPPED}, t AS (SELECT mapping_id, unnest({_UPPER}) AS t FROM mapped), k AS (SELECT technique_id FROM label_targets) SELECT parent, count(*) AS n FROM (SELECT CASE WHEN t IN (FROM k) THEN t WHEN split_part(t, '.', 1) IN (FROM k) THEN split_part(t, '.', 1) END AS parent FROM t) GROUP BY 1")
def parent_ids(spark: SparkSession, d: str) -> DataFrame:
    allowed = gates.registry_ids(table(spark, d, "label_targets"), "technique_id")
    each = mapped(spark, d, "mitre_ids").select(F.explode("mitre_ids").alias("t")).where("t IS NOT NULL").select(F.upper(F.trim("t")).alias("t"))
    return each.groupBy(remap.with_parent(F.col("t"), allowed).alias("parent")).agg(F.count("*").alias("n"))


@query(f"WITH {MAPPED}, x AS (SELECT mapping_id, severity_score / 10 AS s, contains(lower(coalesce(finding_summary, '')), 'printer') AS hint, validation_passed AS ok FROM mapped) SELECT mapping_id, CASE WHEN NOT coalesce(ok, false) AND hint THEN 'vendor hint' WHEN NOT coalesce(ok, false) AND s < 0.42 THEN 'low similarity' WHEN NOT coalesce(ok, false) AND s < 0.48 THEN 'low composite' END AS reason FROM x")
def search_reasons(spark: SparkSession, d: str) -> DataFrame:
    rows = mapped(spark, d).withColumn("s", F.col("severity_score") / 10)
    return rows.select("mapping_id", render.search_reason(F.col("validation_passed"), F.col("s"), F.col("s"), render.hinted(["Printer", ""], F.col("finding_summary"))).alias("reason"))


def _row_key(df: DataFrame) -> Column:
    return F.col("report_id")


_ROWS = "(SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY report_id ORDER BY added_at DESC NULLS LAST) AS k FROM reports) WHERE k = 1)"


@query(f"SELECT min(report_id) AS report_id FROM {_ROWS} GROUP BY technical_summary, mitre_ids")
def content_dedup(spark: SparkSession, d: str) -> DataFrame:
    from sievemill.operators.common import latest

    rows = latest(table(spark, d, "reports").select("report_id", "added_at", "technical_summary", "mitre_ids"), ["report_id"], [F.col("added_at")])
    return dedup.by_content(rows, ["technical_summary", "mitre_ids"], [_row_key(rows)]).select("report_id")


@query("SELECT 0 AS part, technical_summary AS body FROM reports UNION ALL SELECT 1, finding_summary FROM mappings")
def seed_union(spark: SparkSession, d: str) -> DataFrame:
    return dedup.union_seeds(table(spark, d, "reports").select(F.col("technical_summary").alias("body")), table(spark, d, "mappings").select(F.col("finding_summary").alias("body"))).select("part", "body")


@query(rf"WITH {MAPPED} SELECT mapping_id, list_distinct(regexp_extract_all(m, '(?i)Step\s+(\d+)', 1)) AS steps, coalesce(regexp_matches(trim(c), '{fixed.CLI_STEP}'), false) AS command FROM (SELECT mapping_id, 'Step ' || retrieved_examples || ' is short' AS m, CASE WHEN mapping_id % 2 = 0 THEN '  sudo ' || finding_summary ELSE finding_summary END AS c FROM mapped)")
def step_texts(spark: SparkSession, d: str) -> DataFrame:
    told = F.concat(F.lit("Step "), F.col("retrieved_examples").cast("string"), F.lit(" is short"))
    command = F.when(F.col("mapping_id") % 2 == 0, F.concat(F.lit("  sudo "), F.col("finding_summary"))).otherwise(F.col("finding_summary"))
    return mapped(spark, d).select("mapping_id", text.step_numbers(F.array(told)).alias("steps"), F.coalesce(F.trim(command).rlike(fixed.CLI_STEP), F.lit(False)).alias("command"))
