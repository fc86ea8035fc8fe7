"""Queries for vector search, composite correlation, graph tables and resume."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemill.functions import fixed, text
from sievemill.operators import correlate, graph, state, vectors
from sievemill.plans.registry import query, table

NEAR = (
    "q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 100 = 0), s AS (SELECT query_id, e.vec_id AS item_id, e.label, list_cosine_similarity(q.v, e.embedding::DOUBLE[]) AS similarity FROM q, embeddings e WHERE e.vec_id <> query_id), "
    "near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, item_id) AS rank FROM s) WHERE rank <= 8)"
)


def near(spark: SparkSession, d: str, k: int = 8) -> DataFrame:
    """The k nearest embeddings of every one whose id is divisible by 100."""
    items = table(spark, d, "embeddings")
    queries = items.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return vectors.top_k(queries, items, k, query_key="query_id", item_key="vec_id", query_vector="query", item_vector="embedding", skip_self=True)


@query(f"WITH {NEAR} SELECT query_id, item_id AS vec_id, round(similarity, 5) AS similarity, rank::INTEGER AS rank FROM near")
def vector_top_k(spark: SparkSession, d: str) -> DataFrame:
    return near(spark, d).withColumn("similarity", F.round("similarity", 5))


@query(f"WITH {NEAR}, v AS (SELECT query_id, label, sum(similarity) AS votes FROM near GROUP BY 1, 2) SELECT query_id, label, round(votes, 5) AS votes FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY votes DESC, label) AS k FROM v) WHERE k = 1")
def nearest_label(spark: SparkSession, d: str) -> DataFrame:
    neighbours = near(spark, d).join(table(spark, d, "embeddings").select("vec_id", "label"), "vec_id")
    return correlate.knn_vote(neighbours, "label").withColumn("votes", F.round("votes", 5))


GRAPH = "provides AS (SELECT DISTINCT s_name AS vendor_name, l_partkey AS control_id FROM lineitem JOIN supplier ON s_suppkey = l_suppkey), mitigates AS (SELECT p_partkey AS control_id, p_brand AS technique_id FROM part)"
_POOL = (
    "f AS (SELECT e.vec_id AS finding_id, e.embedding::DOUBLE[] AS v, (SELECT list(DISTINCT p_brand) FROM part WHERE p_partkey IN (e.vec_id + 1, e.vec_id + 2)) AS mitre_ids FROM embeddings e WHERE e.vec_id % 100 = 0), "
    "c AS (SELECT p_partkey AS control_id, p_brand, embedding::DOUBLE[] AS v FROM part JOIN embeddings ON vec_id = p_partkey), "
    "pool AS (SELECT * FROM (SELECT finding_id, control_id, mitre_ids, p_brand, list_cosine_similarity(f.v, c.v) AS similarity, row_number() OVER (PARTITION BY finding_id ORDER BY list_cosine_similarity(f.v, c.v) DESC, control_id) AS k FROM f, c) WHERE k <= 100)"
)


def graph_tables(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    suppliers = table(spark, d, "supplier").select("s_suppkey", F.col("s_name").alias("vendor_name"))
    provides = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("s_suppkey"), F.col("l_partkey").alias("control_id")).distinct().join(suppliers, "s_suppkey").select("vendor_name", "control_id").distinct()
    return provides, table(spark, d, "part").select(F.col("p_partkey").alias("control_id"), F.col("p_brand").alias("technique_id"))


@query(
    f"WITH {GRAPH}, {_POOL}, vend AS (SELECT control_id, min(vendor_name) AS vendor, bool_or(lower(vendor_name) LIKE '%00001%') AS hit FROM provides GROUP BY 1), "
    "scored AS (SELECT finding_id, pool.control_id, similarity, similarity + coalesce(0.3 * (list_contains(mitre_ids, p_brand))::INTEGER / len(mitre_ids), 0) + CASE WHEN coalesce(hit, false) THEN 0.2 ELSE 0 END + CASE WHEN vendor IS NOT NULL THEN 0.05 ELSE 0 END AS score, coalesce(list_contains(mitre_ids, p_brand), false) AS mitre_matched, coalesce(hit, false) AS vendor_matched FROM pool LEFT JOIN vend USING (control_id)) "
    "SELECT finding_id, control_id, round(score, 4) AS score, mitre_matched, vendor_matched, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY finding_id ORDER BY score DESC, control_id) AS rank FROM scored) WHERE rank <= 5"
)
def composite_top_n(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "embeddings")
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("control_id"), "p_brand")
    # Sizes decide the join: the optimizer broadcasts or shuffles by id.
    controls = items.join(parts, F.col("vec_id") == F.col("control_id")).select("control_id", "embedding")
    findings = items.where("vec_id % 100 = 0").select(F.col("vec_id").alias("finding_id"), F.col("embedding").alias("query"))
    pool = vectors.top_k(findings, controls, 100, query_key="finding_id", item_key="control_id", query_vector="query", item_vector="embedding")
    asked = findings.select("finding_id", F.explode(F.array(F.col("finding_id") + 1, F.col("finding_id") + 2)).alias("control_id")).join(parts, "control_id").groupBy("finding_id").agg(F.collect_set("p_brand").alias("mitre_ids"))
    provides, mitigates = graph_tables(spark, d)
    wanted = pool.drop("rank").join(asked, "finding_id", "left").withColumn("mitre_ids", F.coalesce("mitre_ids", F.array().cast("array<string>")))
    best = correlate.composite_top_n(wanted, mitigates, provides, allowed=["00001"])
    return best.select("finding_id", "control_id", F.round("score", 4).alias("score"), (F.size("matched_mitre") > 0).alias("mitre_matched"), "vendor_matched", "rank")


@query(f"WITH {GRAPH} SELECT vendor_name, p.control_id, p_name AS description, list_sort(list(DISTINCT technique_id)) AS mitre_ids FROM provides p JOIN part ON p_partkey = p.control_id LEFT JOIN mitigates m ON m.control_id = p.control_id GROUP BY 1, 2, 3")
def graph_export(spark: SparkSession, d: str) -> DataFrame:
    provides, mitigates = graph_tables(spark, d)
    controls = table(spark, d, "part").select(F.col("p_partkey").alias("control_id"), F.col("p_name").alias("description"))
    return graph.export(provides, controls, mitigates)


@query(f"WITH {GRAPH}, one AS (SELECT vendor_name, control_id FROM provides) SELECT vendor_name, control_id::VARCHAR AS node, 1 AS hops FROM one UNION SELECT vendor_name, technique_id, 2 FROM one JOIN mitigates USING (control_id)")
def graph_neighbourhood(spark: SparkSession, d: str) -> DataFrame:
    provides, mitigates = graph_tables(spark, d)
    text_ids = provides.withColumn("control_id", F.col("control_id").cast("string"))
    vendors = table(spark, d, "supplier").select(F.col("s_name").alias("vendor_name"))
    return graph.neighbourhood(vendors, text_ids, mitigates.withColumn("control_id", F.col("control_id").cast("string")))


@query(
    f"WITH {GRAPH}, r AS (SELECT vendor_name, p.control_id::VARCHAR AS cid, technique_id FROM provides p JOIN mitigates m USING (control_id)) SELECT \"group\", count(*) AS n FROM (SELECT DISTINCT 'Framework' AS \"group\", vendor_name AS x FROM r UNION SELECT DISTINCT 'Control', vendor_name || chr(1) || cid FROM r UNION SELECT DISTINCT 'MITRE', technique_id FROM r) GROUP BY 1"
)
def graph_nodes(spark: SparkSession, d: str) -> DataFrame:
    rows = graph_export(spark, d).withColumn("control_id", F.col("control_id").cast("string"))
    nodes, _ = graph.nodes_and_links(rows)
    return nodes.groupBy("group").agg(F.count("*").alias("n"))


@query(f"WITH {GRAPH} SELECT vendor_name AS v, control_id FROM provides WHERE control_id NOT IN (SELECT p_partkey FROM part WHERE p_size > 25)".replace("vendor_name AS v", "vendor_name"))
def unmatched_edges(spark: SparkSession, d: str) -> DataFrame:
    provides, _ = graph_tables(spark, d)
    known = table(spark, d, "part").where("p_size > 25").select(F.col("p_partkey").alias("control_id"))
    return provides.join(known, "control_id", "left_anti").select("vendor_name", "control_id")


@query(
    "WITH w AS (SELECT DISTINCT pdf_path, batch_index FROM progress) SELECT pdf_path, batch_index FROM w WHERE NOT EXISTS (SELECT 1 FROM progress p WHERE p.status = 'ok' AND p.pdf_path IS NOT DISTINCT FROM w.pdf_path AND p.batch_index IS NOT DISTINCT FROM w.batch_index)"
)
def pending_batches(spark: SparkSession, d: str) -> DataFrame:
    log = table(spark, d, "progress")
    return state.pending(log.select("pdf_path", "batch_index").distinct(), log, ["pdf_path", "batch_index"])


@query("SELECT pdf_path, (page_no // 5)::INTEGER AS batch_index, min(page_no) AS start_page, max(page_no) AS end_page, string_agg('--- Page ' || (page_no + 1) || ' ---' || chr(10) || coalesce(page_text, ''), chr(10) || chr(10) ORDER BY page_no) AS text FROM pdf_pages GROUP BY 1, 2")
def page_batches(spark: SparkSession, d: str) -> DataFrame:
    from sievemill.sources.reports import page_batches as batches

    return batches(table(spark, d, "pdf_pages"))


def _benchmark_docs(spark: SparkSession, d: str) -> DataFrame:
    """A document per brand: odd brands list parts under three-part numbers, even ones under rule headers."""
    part = table(spark, d, "part")
    even = F.substring("p_brand", -1, 1).cast("int") % 2 == 0
    number = F.col("p_partkey").cast("string")
    lit = F.lit
    triple = F.concat(lit("1.1."), number, lit(" Ensure "), F.col("p_name"), lit("\n ok\n"), F.col("p_type"), lit(" is set on every system of the plant floor\n"))
    rule = F.concat(lit("2."), number, lit(" WN11-"), number, lit(" (Manual)\nDescription: The "), F.col("p_name"), lit(" must be set on all systems.\nAudit: short\nRemediation: Set the "), F.col("p_type"), lit(" as the vendor says.\n"))
    each = part.select("p_brand", F.struct("p_partkey", F.when(even, rule).otherwise(triple).alias("t")).alias("s"))
    return each.groupBy("p_brand").agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda x: x["t"]), "").alias("body"))  # a document


@query(
    "WITH p AS (SELECT *, right(p_brand, 1)::INTEGER % 2 = 0 AS even FROM part), b AS (SELECT p_brand AS doc_id, p_partkey, CASE WHEN even THEN '2.' || p_partkey || '-WN11-' || p_partkey ELSE '1.1.' || p_partkey END AS label, "
    "CASE WHEN even THEN 'The ' || p_name || ' must be set on all systems. Set the ' || p_type || ' as the vendor says' ELSE 'Ensure ' || p_name || ' ' || p_type || ' is set on every system of the plant floor' END AS description, even FROM p), "
    "k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY p_partkey) - 1 AS place FROM b WHERE length(description) >= CASE WHEN even THEN 80 ELSE 51 END) SELECT doc_id, place::INTEGER AS place, label, description FROM k WHERE place < 14"
)
def benchmark_controls(spark: SparkSession, d: str) -> DataFrame:
    from sievemill.sources.reports import benchmark_controls as controls

    return controls(_benchmark_docs(spark, d), "p_brand", "body")


@query(
    "WITH t AS (SELECT p_partkey, lower(p_name || ' ' || p_type) AS u FROM part), f AS (SELECT p_partkey, ["
    + ", ".join(f"CASE WHEN {' OR '.join(chr(99) + f'ontains(u, {chr(39)}{w}{chr(39)})' for w in words)} THEN [{', '.join(chr(39) + i + chr(39) for i in ids)}] ELSE [] END" for words, ids in fixed.TECHNIQUE_FAMILIES)
    + "] AS l FROM t), g AS (SELECT p_partkey, flatten(l) AS g FROM f), h AS (SELECT p_partkey, CASE WHEN len(g) = 0 THEN ['T1078', 'T1046'] WHEN len(g) = 1 THEN g || ['T1190'] ELSE g[1:3] END AS ids FROM g) SELECT p_partkey, ids FROM h"
)
def control_techniques(spark: SparkSession, d: str) -> DataFrame:
    from sievemill.functions import render

    return table(spark, d, "part").select("p_partkey", render.control_techniques("p_name", "p_type").alias("ids"))


@query(r"WITH one AS (SELECT pdf_path, page_no, max(coalesce(page_text, '')) AS t FROM pdf_pages GROUP BY 1, 2), w AS (SELECT pdf_path, string_agg(t, chr(10) ORDER BY page_no) AS body FROM one GROUP BY 1) SELECT pdf_path AS doc_id, len(regexp_extract_all(body, '(?m)^[ \t]*\d+(?:\.\d+)+[ \t]+'))::INTEGER AS n_blocks FROM w WHERE regexp_matches(body, '(?m)^[ \t]*\d+(?:\.\d+)+[ \t]+')")
def benchmark_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Numbered blocks of whole files."""
    from sievemill.sources.reports import benchmark_blocks as blocks
    from sievemill.sources.reports import whole_documents

    found = blocks(whole_documents(table(spark, d, "pdf_pages")), "pdf_path", "body", least=0)
    return found.groupBy("doc_id").agg(F.count("*").cast("int").alias("n_blocks"))


@query("SELECT pdf_path, page_no, regexp_replace(trim(regexp_replace(coalesce(page_text, ''), '[\\s\\x{a0}]+', ' ', 'g')), ' ', ' ', 'g') AS text FROM pdf_pages")
def collapsed_pages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pdf_pages").select("pdf_path", "page_no", text.collapse(F.coalesce("page_text", F.lit(""))).alias("text"))


@query("SELECT c_custkey, count(o_orderkey) AS n_orders, round(coalesce(sum(o_totalprice), 0), 2) AS total FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def outer_join_totals(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("t"))
    return table(spark, d, "customer").select("c_custkey").join(orders, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n_orders"), F.round(F.coalesce("t", F.lit(0.0)), 2).alias("total"))
