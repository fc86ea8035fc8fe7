"""Queries over structures: detector rows, graph, catalog, resume, cache, verification, reranking, table exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemill.functions import fixed, text
from sievemill.operators import correlate, detect, gates, graph, state, stats, verify
from sievemill.plans.correlation import GRAPH, composite_top_n, graph_tables, near
from sievemill.plans.extraction import _any, _ordered, _tokens, _words
from sievemill.plans.findings import FLOWS, LIVE, MAPPED, flows, live, mapped
from sievemill.plans.registry import SQL, query, table
from sievemill.sources import csvs, reports

_PORTS = ", ".join(str(p) for p in fixed.SUSPICIOUS_PORTS)


@query(
    f"WITH {FLOWS}, pairs AS (SELECT DISTINCT src, dst_port FROM flows WHERE proto IN ('TCP', 'UDP')) SELECT kind, severity, src, dst, port, amount::BIGINT AS amount, order_class, order_key::BIGINT AS order_key FROM ("
    f"SELECT 'suspicious_port' AS kind, 'medium' AS severity, src, dst, dst_port AS port, 1 AS amount, 0 AS order_class, seq AS order_key FROM flows WHERE proto = 'TCP' AND dst_port IN ({_PORTS}) "
    "UNION ALL SELECT 'large_dns_query', 'low', src, dst, 53, length, 0, seq FROM flows WHERE proto = 'UDP' AND dst_port = 53 AND length > 512 "
    "UNION ALL SELECT 'port_scan', 'high', src, NULL, NULL, count(dst_port), 1, 0 FROM pairs GROUP BY src HAVING count(dst_port) >= 2 "
    "UNION ALL SELECT 'connection_flood', 'medium', src, dst, NULL, count(*), 2, 0 FROM flows GROUP BY src, dst HAVING count(*) >= 2)"
)
def anomaly_rows(spark: SparkSession, d: str) -> DataFrame:
    return detect.events(flows(spark, d), scan_ports=2, flood_packets=2).select("kind", "severity", "src", "dst", "port", "amount", "order_class", "order_key")


@query(f"WITH {FLOWS} SELECT 'summary' AS kind, 'info' AS severity, count(*) AS amount FROM flows WHERE proto = 'ICMP'")
def quiet_capture(spark: SparkSession, d: str) -> DataFrame:
    return detect.events_or_summary(flows(spark, d).where("proto = 'ICMP'"), flood_packets=10**9).select("kind", "severity", "amount")


@query(f"WITH {MAPPED}, p AS (SELECT DISTINCT t AS technique_id, finding_id FROM (SELECT finding_id, unnest(list_transform(mitre_ids, lambda x: upper(trim(x)))) AS t FROM mapped) WHERE regexp_matches(t, '^T\\d{{4}}(\\.\\d{{3}})?$')) SELECT technique_id, finding_id, count(*) OVER (PARTITION BY technique_id) AS n_findings FROM p")
def technique_findings(spark: SparkSession, d: str) -> DataFrame:
    return stats.technique_findings(mapped(spark, d, "finding_id", "mitre_ids").select("finding_id", F.explode(text.normal_ids("mitre_ids")).alias("technique_id")))


@query(f"WITH {MAPPED}, {LIVE}, s AS (SELECT finding_id, nullif(trim(title), '') IS NOT NULL AS good FROM live) SELECT count(*) AS n_findings, count(*) FILTER (good AND finding_id IN (SELECT finding_id FROM mapped)) AS n_mapped, count(*) FILTER (NOT good) AS n_skipped FROM s")
def run_stats(spark: SparkSession, d: str) -> DataFrame:
    return stats.run_stats(live(spark, d, "title").withColumnRenamed("title", "technical_summary"), mapped(spark, d, "finding_id"))


_CATALOG = "c AS (SELECT technique_id, CASE row_number_in WHEN 0 THEN 'execution' WHEN 1 THEN 'impact' ELSE 'other' END AS tactic FROM (SELECT technique_id, row_count_tag_in_train % 3 AS row_number_in FROM label_targets WHERE row_count_tag_in_train IS NOT NULL))"


def _catalog(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("row_count_tag_in_train") % 3
    rows = table(spark, d, "label_targets").where("row_count_tag_in_train IS NOT NULL")
    return rows.select("technique_id", F.when(kind == 0, "execution").when(kind == 1, "impact").otherwise("other").alias("tactic"))


@query(f"WITH {_CATALOG} SELECT tactic, list_sort(list(DISTINCT technique_id)) AS technique_ids, CASE tactic WHEN 'impact' THEN 1 WHEN 'execution' THEN 2 ELSE 3 END AS place FROM c GROUP BY 1")
def tactic_columns(spark: SparkSession, d: str) -> DataFrame:
    return stats.by_tactic(_catalog(spark, d), ["impact", "execution"])


@query(f"WITH {_CATALOG}, u AS (SELECT technique_id, tactic, 'first' AS name, 0 AS k FROM c WHERE tactic <> 'other' UNION ALL SELECT technique_id, tactic, 'second', 1 FROM c) SELECT tactic, technique_id, arg_min(name, k) AS name FROM u GROUP BY 1, 2")
def catalog_union(spark: SparkSession, d: str) -> DataFrame:
    rows = _catalog(spark, d)
    return stats.catalog_union(rows.where("tactic <> 'other'").withColumn("name", F.lit("first")), rows.withColumn("name", F.lit("second"))).select("tactic", "technique_id", "name")


@query("SELECT technique_id, (row_number() OVER (ORDER BY technique_id) - 1)::BIGINT AS number FROM label_targets")
def numbered_targets(spark: SparkSession, d: str) -> DataFrame:
    return graph.numbered(table(spark, d, "label_targets").select("technique_id"), "technique_id")


@query(
    "WITH t AS (SELECT technique_id AS target, row_number() OVER (ORDER BY technique_id) - 1 AS k FROM label_targets WHERE min_rows IS NULL OR min_rows % 2 = 0), c AS (SELECT s_name AS source, row_number() OVER (ORDER BY s_name) - 1 AS k FROM supplier) "
    "SELECT source, target FROM t JOIN c ON t.k % (SELECT count(*) FROM supplier) = c.k"
)
def orphan_links(spark: SparkSession, d: str) -> DataFrame:
    """A link for every technique that has none; those with an odd floor have one."""
    targets = table(spark, d, "label_targets")
    links = targets.where("min_rows % 2 = 1").select(F.lit("x").alias("source"), F.col("technique_id").alias("target"))
    return graph.attach_orphans(targets.select("technique_id"), links, table(spark, d, "supplier").select(F.col("s_name").alias("control_id")))


@query(
    "WITH new AS (SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE 'new ' || s_name END AS s_name, 1 AS at FROM supplier WHERE s_suppkey % 2 = 0 UNION ALL SELECT s_suppkey + 1000000, s_name, 0 FROM supplier WHERE s_suppkey % 3 = 0) "
    "SELECT coalesce(n.s_suppkey, s.s_suppkey) AS s_suppkey, coalesce(n.s_name, s.s_name) AS s_name FROM supplier s FULL JOIN new n ON n.s_suppkey = s.s_suppkey"
)
def upserted_vendors(spark: SparkSession, d: str) -> DataFrame:
    stored = table(spark, d, "supplier").select("s_suppkey", "s_name")
    new = stored.where("s_suppkey % 2 = 0").select("s_suppkey", F.when(F.col("s_suppkey") % 4 == 0, None).otherwise(F.concat(F.lit("new "), "s_name")).alias("s_name"), F.lit(1).alias("at"))
    more = stored.where("s_suppkey % 3 = 0").select((F.col("s_suppkey") + 1000000).alias("s_suppkey"), "s_name", F.lit(0).alias("at"))
    return graph.upsert(stored, new.unionByName(more), "s_suppkey", [F.col("at")])


@query(f"WITH {GRAPH}, m AS (SELECT DISTINCT control_id, upper(technique_id) AS technique_id FROM mitigates) SELECT control_id, technique_id FROM m UNION SELECT p_partkey, upper(p_type) FROM part")
def upserted_edges(spark: SparkSession, d: str) -> DataFrame:
    controls = table(spark, d, "part").select(F.col("p_partkey").alias("control_id"), F.array(F.col("p_brand"), F.lit(" "), F.concat(F.lit(" "), "p_type"), F.lit(None).cast("string")).alias("mitre_ids"))
    _, stored = graph_tables(spark, d)
    return graph.upsert_edges(stored.select("control_id", F.upper("technique_id").alias("technique_id")), graph.technique_edges(controls))


@query("SELECT p_brand AS k, count(*) AS n_rows FROM part GROUP BY 1 HAVING count(*) > 1")
def repeated_keys(spark: SparkSession, d: str) -> DataFrame:
    return graph.violations(table(spark, d, "part").select(F.col("p_brand").alias("k")), "k")


@query(
    "WITH n AS (SELECT p_partkey, upper('ac-' || lpad((p_partkey % 40 + 1)::VARCHAR, 2, '0')) AS key, trim(p_name) AS title, CASE WHEN p_size % 5 = 0 THEN '' ELSE 'Do ' || p_type END AS prose FROM part), "
    "m AS (SELECT 'AC-' || lpad((n_nationkey % 40 + 1)::VARCHAR, 2, '0') AS key, list_sort(list(DISTINCT n_name)) AS ids FROM nation WHERE n_regionkey <> 0 GROUP BY 1) "
    "SELECT key, 'NIST-' || key AS control_id, title || chr(10) || chr(10) || prose AS remediation, coalesce(ids, []) AS mitre_ids FROM n LEFT JOIN m USING (key) WHERE prose <> ''"
)
def control_records(spark: SparkSession, d: str) -> DataFrame:
    part, nation = table(spark, d, "part"), table(spark, d, "nation")
    number = lambda c: F.concat(F.lit("ac-"), (F.col(c) % 40 + 1).cast("string"))
    nested = part.select(number("p_partkey").alias("control_id"), F.col("p_name").alias("title"), F.when(F.col("p_size") % 5 == 0, "").otherwise(F.concat(F.lit("Do "), "p_type")).alias("prose"))
    mapping = nation.select(number("n_nationkey").alias("capability_id"), F.col("n_name").alias("attack_object_id"), F.when(F.col("n_regionkey") == 0, "other").otherwise("mitigates").alias("mapping_type"))
    return graph.control_records(nested, mapping)


@query("SELECT DISTINCT 'T1' || lpad(n_nationkey::VARCHAR, 3, '0') AS technique_id FROM nation WHERE n_regionkey NOT IN (1, 2) AND n_nationkey <> 7")
def bundle_allow_list(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "nation").select(F.when(F.col("n_nationkey") == 7, "malware").otherwise("attack-pattern").alias("type"), F.concat(F.lit("t1"), F.lpad(F.col("n_nationkey").cast("string"), 3, "0")).alias("technique_id"), (F.col("n_regionkey") == 1).alias("revoked"), F.when(F.col("n_regionkey") == 2, True).alias("x_mitre_deprecated"))
    return gates.bundle_ids(rows.union(rows))


@query("WITH w AS (SELECT DISTINCT pdf_path, batch_index FROM progress WHERE pdf_path IS NOT NULL) SELECT pdf_path AS catalog, batch_index AS join_key FROM w WHERE NOT EXISTS (SELECT 1 FROM progress p WHERE p.entry_id % 2 = 0 AND p.status IN ('ok', 'skipped') AND p.pdf_path = w.pdf_path AND p.batch_index IS NOT DISTINCT FROM w.batch_index)")
def pending_controls(spark: SparkSession, d: str) -> DataFrame:
    """Log entries with an even number are of the control kind."""
    log = table(spark, d, "progress").select(F.col("pdf_path").alias("catalog"), F.col("batch_index").alias("join_key"), "status", F.when(F.col("entry_id") % 2 == 0, "oscal").otherwise("pdf").alias("kind"))
    return state.pending_controls(log.select("catalog", "join_key").where("catalog IS NOT NULL").distinct(), log)


@query(f"WITH {LIVE}, {MAPPED}, k AS (SELECT nullif(trim(title), '') AS key FROM live), c AS (SELECT DISTINCT title AS key FROM reports) SELECT count(*) FILTER (k.key IN (FROM c)) AS hits, count(*) FILTER (NOT coalesce(k.key IN (FROM c), false)) AS misses, round(count(*) FILTER (k.key IN (FROM c)) / count(*), 6) AS hit_rate FROM k".replace("k.key IN (FROM c)", "k.key IN (SELECT key FROM c WHERE key IS NOT NULL)"))
def cache_hits(spark: SparkSession, d: str) -> DataFrame:
    cache = table(spark, d, "reports").where("title IS NOT NULL").select(F.col("title").alias("key"), F.col("technical_summary").alias("summary"))
    keys = live(spark, d, "title").select(text.blank_to_null("title").alias("key"))
    return state.hit_rate(state.cache_lookup(keys, cache)).withColumn("hit_rate", F.round("hit_rate", 6))


@query(f"WITH {LIVE} SELECT finding_id FROM live ORDER BY row_no DESC NULLS LAST, finding_id LIMIT 25")
def first_rows(spark: SparkSession, d: str) -> DataFrame:
    return state.first_rows(live(spark, d, "row_no"), [F.desc_nulls_last("row_no"), F.col("finding_id")], 25).select("finding_id")


_STEPS = (
    "r AS (SELECT report_id, coalesce(technical_summary, '') AS summary, title, services, ports, cve_ids, coalesce(title, '') || ' ' || coalesce(array_to_string(services, ' '), '') AS source, list_transform(list_filter(coalesce(mitre_ids, []), lambda x: x IS NOT NULL), lambda x: upper(trim(x))) AS ids FROM (SELECT *, row_number() OVER (PARTITION BY report_id ORDER BY added_at DESC NULLS LAST) AS k FROM reports) WHERE k = 1), "
    "s AS (SELECT *, concat_ws(' ', title, summary, array_to_string(services, ' '), CASE WHEN report_id % 2 = 0 THEN 'Settings' ELSE '' END, 'ui', coalesce(array_to_string(ports, ' '), '')) AS one, concat_ws(' ', 'Confirm', 'sudo check', 'done', '', '', 'Look twice') AS two FROM r)"
)
_STEP = lambda x: _tokens(x, "[a-z0-9" + chr(92) * 2 + "/.]+", fixed.STEP_STOPWORDS)
VERIFIED = (
    f"{_STEPS}, t AS (SELECT *, {_STEP('source')} AS src, {_STEP('one')} AS w1, {_STEP('two')} AS w2, {_STEP('summary')} AS asked, {_STEP(chr(40) + 'one || chr(32) || two' + chr(41))} AS all_words, upper(one || ' ' || two) AS loud, "
    "list_filter([cve_ids[1]] || coalesce(services, []) || coalesce(ports, []), lambda c: c IS NOT NULL AND c <> '') AS listed FROM s), "
    "u AS (SELECT *, list_filter(listed, lambda c, i: list_position(listed, c) = i)[1:3] AS top FROM t), "
    "v AS (SELECT report_id, (list_has_any(w1, src)::INTEGER + list_has_any(w2, src)::INTEGER) / 2 AS g, (CASE WHEN len(asked) > 0 THEN len(list_intersect(asked, all_words)) / len(asked) ELSE 0 END + CASE WHEN len(ids) > 0 THEN len(list_filter(ids, lambda x: contains(loud, x))) / len(ids) ELSE 1 END) / 2 AS r, "
    "CASE WHEN len(top) > 0 THEN len(list_filter(top, lambda c: len(list_filter(coalesce(cve_ids, []), lambda y: starts_with(c, y) OR starts_with(y, c))) > 0)) / len(top) ELSE 1.0 END AS c0, len(top) > 0 AND len(list_filter(top, lambda c: len(list_filter(coalesce(cve_ids, []), lambda y: starts_with(c, y) OR starts_with(y, c))) > 0)) = 0 AND report_id % 3 = 0 AS lifted, "
    "((coalesce(len(ports), 0) > 0)::INTEGER + 1) / 2 AS q FROM u), x AS (SELECT report_id, g, r, CASE WHEN lifted THEN greatest(c0, 0.5) ELSE c0 END AS c, q FROM v)"
)


@query(f"WITH {VERIFIED} SELECT report_id, round(g, 4) AS grounding, round(r, 4) AS relevance, round(c, 4) AS completeness, round(q, 4) AS substep_quality, g >= 0.7 AND r >= 0.5 AND c >= 0.5 AND q >= 0.7 AS passed FROM x")
def verification_scores(spark: SparkSession, d: str) -> DataFrame:
    """Two steps per labelled record, made of its own fields, checked against its title and services."""
    from sievemill.operators.common import latest

    rows = latest(table(spark, d, "reports").select("report_id", "added_at", "technical_summary", "title", "services", "ports", "cve_ids", "mitre_ids"), ["report_id"], [F.col("added_at")])
    none = F.lit(None).cast("string")

    def step(number, title, command, explanation, kind, crumb, subs):
        return F.struct(F.lit(number).alias("step_number"), title.alias("title"), command.alias("command_or_action"), explanation.alias("explanation"), kind.alias("step_type"), crumb.alias("ui_breadcrumb"), subs.alias("substeps"))

    listed = lambda c: F.array_join(c, " ")
    summary = F.coalesce("technical_summary", F.lit(""))
    first = step(1, F.col("title"), summary, listed("services"), F.lit("ui"), F.when(F.col("report_id") % 2 == 0, "Settings"), F.col("ports"))
    second = step(2, F.lit("Confirm"), F.lit("sudo check"), F.lit("done"), none, none, F.array(F.lit("Look twice")))
    ids = F.transform(F.filter(F.coalesce("mitre_ids", F.array().cast("array<string>")), lambda t: t.isNotNull()), lambda t: F.upper(F.trim(t)))
    made = rows.select(
        "report_id", F.array(first, second).alias("steps"), F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce(listed("services"), F.lit(""))).alias("source"), summary.alias("summary"), ids.alias("mitre_ids"),
        F.get("cve_ids", F.lit(0)).alias("best"), F.col("services").alias("vendor_ids"), F.col("ports").alias("framework_ids"), F.coalesce("cve_ids", F.array().cast("array<string>")).alias("references"),
    )
    return verify.verdict(made, lifted=F.col("report_id") % 3 == 0).select("report_id", "grounding", "relevance", "completeness", "substep_quality", "passed")


@query(
    f"WITH {MAPPED}, v AS (SELECT mapping_id, list_transform(range(0, coalesce(retrieved_examples, 0)), lambda i: CASE (mapping_id + i) % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.5 ELSE 0.0 END) AS v, severity_score / 10 AS h FROM mapped), s AS (SELECT mapping_id, h, CASE WHEN len(v) > 0 THEN list_sum(v) / len(v) ELSE 0 END AS j FROM v) "
    "SELECT mapping_id, round(j, 6) AS judged, round(CASE WHEN h >= 1 THEN h ELSE (h + j) / 2 END, 6) AS combined FROM s"
)
def judge_scores(spark: SparkSession, d: str) -> DataFrame:
    """Verdicts in turn for as many steps as a mapping has retrieved examples."""
    n = F.coalesce("retrieved_examples", F.lit(0))
    kinds = F.array(F.lit("SUPPORTED"), F.lit(" partially_supported: half"), F.lit("NOT_SUPPORTED"))
    said = F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: F.get(kinds, ((F.col("mapping_id") + i) % 3).cast("int")))).otherwise(F.array().cast("array<string>"))
    rows = mapped(spark, d, "retrieved_examples", "severity_score").withColumn("v", said)
    judged = verify.judged("v")
    return rows.select("mapping_id", F.round(judged, 6).alias("judged"), F.round(verify.combined(F.col("severity_score") / 10, judged), 6).alias("combined"))


@query(
    "WITH base AS (" + SQL["composite_top_n"] + f"), n AS (SELECT p_partkey, {_tokens('p_name', '[a-z0-9]+', fixed.STOPWORDS)} AS w FROM part), "
    "j AS (SELECT b.finding_id, b.control_id, b.rank, score - CASE WHEN len(coalesce(f.w, [])) > 0 AND NOT list_has_any(f.w, c.w) THEN 0.15 ELSE 0 END AS adjusted FROM base b LEFT JOIN n f ON f.p_partkey = b.finding_id + 1 LEFT JOIN n c ON c.p_partkey = b.control_id) "
    "SELECT finding_id, control_id, (row_number() OVER (PARTITION BY finding_id ORDER BY adjusted DESC, rank))::INTEGER AS reranked FROM j"
)
def keyword_rerank(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "part").select("p_partkey", text.tokens("p_name").alias("w"))
    best = composite_top_n(spark, d)
    asked = names.select((F.col("p_partkey") - 1).alias("finding_id"), F.col("w").alias("f"))
    held = names.select(F.col("p_partkey").alias("control_id"), F.col("w").alias("c"))
    return correlate.keyword_rerank(best.join(asked, "finding_id", "left").join(held, "control_id", "left"), "f", "c").select("finding_id", "control_id", "reranked")


@query("WITH base AS (" + SQL["composite_top_n"] + f"), v AS (WITH {GRAPH} SELECT control_id, min(vendor_name) AS vendor FROM provides GROUP BY 1) SELECT coalesce(vendor <> (SELECT min(s_name) FROM supplier), false) AS of_vendor, count(*) AS n FROM base LEFT JOIN v USING (control_id) GROUP BY 1")
def vendor_split(spark: SparkSession, d: str) -> DataFrame:
    provides, _ = graph_tables(spark, d)
    framework = table(spark, d, "supplier").agg(F.min("s_name")).first()[0]
    vendor = provides.groupBy("control_id").agg(F.min("vendor_name").alias("vendor"))
    own, other = correlate.split_by_vendor(composite_top_n(spark, d).join(vendor, "control_id", "left"), framework)
    both = own.select(F.lit(True).alias("of_vendor")).unionByName(other.select(F.lit(False).alias("of_vendor")))
    return both.groupBy("of_vendor").agg(F.count("*").alias("n"))


_TT = "MAP {" + ", ".join(f"'{k}': {_words(v)}" for k, v in fixed.TECHNIQUE_TACTICS.items()) + "}"
_PRESENT = "list_filter([" + ", ".join(f"CASE WHEN {_any('low', words)} THEN '{t}' END" for t, words in fixed.TACTIC_WORDS.items()) + "], lambda x: x IS NOT NULL)"


@query(
    "WITH b AS (" + SQL["vector_top_k"] + f"), m AS (SELECT mapping_id, max(finding_summary) AS s FROM mappings GROUP BY 1), j AS (SELECT b.*, s, lower(coalesce(s, '')) AS low, CASE vec_id % 3 WHEN 0 THEN ['T1190', 'T1059.001'] WHEN 1 THEN ['T1102'] ELSE ['T1110', 'T9999'] END AS labels, {_TT} AS tt FROM b LEFT JOIN m ON mapping_id = query_id), "
    f"k AS (SELECT *, {_PRESENT} AS present, regexp_matches(coalesce(s, ''), '{fixed.C2_EVIDENCE}') AS c2 FROM j), "
    "a AS (SELECT query_id, vec_id, rank, similarity + 0.12 * len(list_filter(labels, lambda x: coalesce(list_has_any(tt[split_part(x, '.', 1)], present), false))) - 0.35 * CASE WHEN c2 THEN 0 ELSE len(list_filter(labels, lambda x: split_part(x, '.', 1) = 'T1102')) END AS adjusted FROM k) "
    "SELECT query_id, vec_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY adjusted DESC, rank) AS n FROM a) WHERE n = 1"
)
def example_rerank(spark: SparkSession, d: str) -> DataFrame:
    """The best of eight neighbours after tactics are compared; labels follow the neighbour's number."""
    told = table(spark, d, "mappings").groupBy("mapping_id").agg(F.max("finding_summary").alias("summary"))
    kind = F.col("vec_id") % 3
    of = lambda *ids: F.array(*[F.lit(t) for t in ids])
    pool = near(spark, d).withColumn("similarity", F.round("similarity", 5)).withColumn("labels", F.when(kind == 0, of("T1190", "T1059.001")).when(kind == 1, of("T1102")).otherwise(of("T1110", "T9999")))
    return correlate.example_rerank(pool.join(told, F.col("mapping_id") == F.col("query_id"), "left")).select("query_id", "vec_id")


_CSV = f"{LIVE}, c AS (SELECT finding_id, (row_number() OVER (ORDER BY finding_id) - 1)::BIGINT AS row_no, nullif(trim(title), '') AS title, nullif(trim(description), '') AS description, lower(trim(severity)) AS sev, cvss_score, nullif(trim(array_to_string(cve_ids, ',')), '') AS cve, nullif(trim(source_ip), '') AS host FROM live)"


@query(
    rf"WITH {_CSV} SELECT row_no, {_ordered('coalesce(sev, $$$$)', fixed.SEVERITY_WORDS)} AS severity, coalesce(title, 'Entry ' || (row_no + 1))[1:500] AS title, CASE WHEN cvss_score BETWEEN 0 AND 10 THEN cvss_score END AS cvss_score, "
    f"list_sort(list_distinct(regexp_extract_all(coalesce(description, ''), '{fixed.CVE}') || regexp_extract_all(coalesce(cve, ''), '{fixed.CVE}'))) AS cve_ids, list_filter([host], lambda x: x IS NOT NULL) AS hosts FROM c"
)
def csv_findings(spark: SparkSession, d: str) -> DataFrame:
    """Findings written as a scanner's table under other names and read back."""
    rows = live(spark, d, "title", "description", "severity", "cvss_score", "cve_ids", "source_ip").select("finding_id", F.col("title").alias("Vulnerability"), F.col("description").alias("Details"), F.col("severity").alias("Risk_Level"), F.col("cvss_score").cast("string").alias("CVSS-Score"), F.array_join("cve_ids", ",").alias("CVEs"), F.col("source_ip").alias("IP Address"))
    made = csvs.findings(rows, "table.csv", order=["finding_id"])
    return made.select("row_no", "severity", "title", "cvss_score", "cve_ids", F.transform("affected_assets", lambda a: a["identifier"]).alias("hosts"))


@query(
    f"WITH {LIVE} SELECT (row_number() OVER (ORDER BY finding_id) - 1)::BIGINT AS row_no, 'From: ' || coalesce(trim(source_ip), '') || ' | To: ' || coalesce(trim(destination_ip), '') || ' | Action: ' || coalesce(trim(severity), '') AS title, nullif(trim(source_ip), '') AS source_ip, nullif(trim(destination_ip), '') AS destination_ip, nullif(trim(protocol), '') AS protocol, timestamp_observed FROM live"
)
def csv_log_findings(spark: SparkSession, d: str) -> DataFrame:
    """The same table in the style of a log."""
    rows = live(spark, d, "source_ip", "destination_ip", "protocol", "severity", "timestamp_observed").select("finding_id", F.col("timestamp_observed").cast("string").alias("log_time"), F.col("source_ip").alias("src"), F.col("destination_ip").alias("dst"), F.col("protocol").alias("proto"), F.col("severity").alias("action"))
    return csvs.findings(rows, "log.csv", order=["finding_id"]).select("row_no", "title", "source_ip", "destination_ip", "protocol", "timestamp_observed")


@query(
    f"WITH {LIVE}, e AS (SELECT *, list_distinct(list_filter(list_transform(string_split(coalesce(source_ip, '') || ', ' || coalesce(array_to_string(hostnames, ','), ''), ','), lambda x: trim(x)), lambda x: x <> '')) AS h FROM live) SELECT finding_id, {_ordered('lower(coalesce(severity, $$$$))', fixed.SEVERITY_TEXT_WORDS)} AS severity, coalesce(title, raw_excerpt)[1:500] AS title, list_sort(h) AS hosts, "
    f"regexp_extract_all(coalesce(array_to_string(cve_ids, ' '), ''), '{fixed.CVE}') AS cve_ids, CASE WHEN cvss_score BETWEEN 0 AND 10 THEN cvss_score END AS cvss_score, coalesce(len(ports), 0)::INTEGER AS n_ports FROM e"
)
def extraction_findings(spark: SparkSession, d: str) -> DataFrame:
    """Findings as attributes of an extraction, and back."""
    rows = live(spark, d, "severity", "title", "description", "source_ip", "hostnames", "cve_ids", "cvss_score", "ports", "services", "raw_excerpt")
    listed = lambda c: F.array_join(c, ",").alias(c)
    shaped = rows.select("finding_id", "severity", "title", "description", F.col("source_ip").alias("affected_hosts"), listed("hostnames"), F.array_join("cve_ids", " ").alias("cve_ids"), F.col("cvss_score").cast("string").alias("cvss_score"), listed("ports"), listed("services"), F.lit("Patch it.").alias("remediation"), F.col("raw_excerpt").alias("extraction_text"))
    made = reports.extraction_findings(shaped)
    return made.select("finding_id", "severity", "title", F.array_sort(F.transform("affected_assets", lambda a: a["identifier"])).alias("hosts"), "cve_ids", "cvss_score", F.size("ports").alias("n_ports"))


@query(f"WITH {LIVE} SELECT finding_id, title AS technical_summary, coalesce(cvss_score) AS severity_score, ((source_ip IS NOT NULL)::INTEGER + (destination_ip IS NOT NULL)::INTEGER)::INTEGER AS n_metadata, coalesce(cve_ids, []) AS cve_ids FROM live WHERE trim(coalesce(title, '')) <> ''")
def mapper_inputs(spark: SparkSession, d: str) -> DataFrame:
    rows = live(spark, d, "title", "cvss_score", "source_ip", "destination_ip", "cve_ids", "services", "ports").withColumn("technical_summary", F.col("title"))
    return state.mapper_input(rows).select("finding_id", "technical_summary", "severity_score", F.size("source_metadata").alias("n_metadata"), "cve_ids")


@query(f"WITH {MAPPED} SELECT mapping_id AS query_id, coalesce(nullif(trim(finding_summary), ''), nullif(trim(routing_mode), ''), '') AS technical_summary, CASE WHEN len(mitre_ids) > 0 THEN mitre_ids WHEN trim(coalesce(routing_mode, '')) <> '' THEN [routing_mode] ELSE [] END AS mitre_ids, severity_score AS similarity_score FROM mapped")
def reference_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = mapped(spark, d, "finding_summary", "routing_mode", "mitre_ids", "severity_score").select(F.col("mapping_id").alias("query_id"), F.col("finding_summary").alias("technical_summary"), F.col("routing_mode").alias("text"), F.col("mitre_ids").alias("verified_mitre_ids"), F.col("routing_mode").alias("mitre_id"), F.col("severity_score").alias("score"))
    return state.reference_rows(rows)
