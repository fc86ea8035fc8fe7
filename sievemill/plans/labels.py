"""Queries over labelled rows: reports with their technique ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemill.functions import text
from sievemill.operators import labels, metrics
from sievemill.operators.common import latest
from sievemill.plans.registry import query, table

ROWS = (
    r"rows AS (SELECT report_id AS id, list_distinct(list_filter(list_transform(coalesce(mitre_ids, []), lambda x: upper(trim(x))), lambda x: regexp_matches(x, '^T\d{4}(\.\d{3})?$'))) AS tags FROM "
    "(SELECT *, row_number() OVER (PARTITION BY report_id ORDER BY added_at DESC NULLS LAST) AS k FROM reports) WHERE k = 1), flat AS (SELECT id, unnest(tags) AS tag FROM rows), counts AS (SELECT tag, count(*) AS n_rows FROM flat GROUP BY 1)"
)


def rows(spark: SparkSession, d: str) -> DataFrame:
    one = latest(table(spark, d, "reports").select("report_id", "added_at", "mitre_ids"), ["report_id"], [F.col("added_at")])
    return one.select(F.col("report_id").alias("id"), text.normal_ids("mitre_ids").alias("tags"))


@query(f"WITH {ROWS} SELECT tag, n_rows FROM counts")
def label_histogram(spark: SparkSession, d: str) -> DataFrame:
    return labels.histogram(rows(spark, d))


@query(f"WITH {ROWS} SELECT tag, n_rows FROM counts ORDER BY n_rows DESC, tag LIMIT 10")
def common_labels(spark: SparkSession, d: str) -> DataFrame:
    return labels.most_common(labels.histogram(rows(spark, d)), 10)


@query(f"WITH {ROWS} SELECT tag, n_rows FROM counts ORDER BY n_rows, tag LIMIT 10")
def rare_labels(spark: SparkSession, d: str) -> DataFrame:
    return labels.rarest(labels.histogram(rows(spark, d)), 10)


@query(f"WITH {ROWS}, top AS (SELECT tag FROM counts ORDER BY n_rows DESC, tag LIMIT 28), kept AS (SELECT * FROM flat WHERE tag IN (SELECT tag FROM top)) SELECT a.tag AS tag_a, b.tag AS tag_b, count(*) AS n_rows FROM kept a JOIN kept b ON a.id = b.id AND a.tag <> b.tag GROUP BY 1, 2")
def label_pairs(spark: SparkSession, d: str) -> DataFrame:
    return labels.co_occurrence(rows(spark, d))


@query(f"WITH {ROWS} SELECT len(tags)::INTEGER AS n_tags, count(*) AS n_rows FROM rows GROUP BY 1")
def label_cardinality(spark: SparkSession, d: str) -> DataFrame:
    return labels.cardinality(rows(spark, d))


@query(f"WITH {ROWS} SELECT round(avg(len(tags)), 6) AS mean_tags, max(len(tags))::INTEGER AS max_tags, count(*) AS n_rows FROM rows")
def label_cardinality_stats(spark: SparkSession, d: str) -> DataFrame:
    return labels.cardinality_stats(rows(spark, d)).withColumn("mean_tags", F.round("mean_tags", 6))


@query(f"WITH {ROWS}, t AS (SELECT list(technique_id) AS ok FROM label_targets) SELECT count(*) AS n_tags, count(*) FILTER (NOT (list_contains(ok, tag) OR list_contains(ok, split_part(tag, '.', 1)))) AS n_bad, round(count(*) FILTER (NOT (list_contains(ok, tag) OR list_contains(ok, split_part(tag, '.', 1)))) / count(*), 6) AS bad_share FROM flat, t")
def invalid_labels(spark: SparkSession, d: str) -> DataFrame:
    from sievemill.operators.gates import registry_ids

    return labels.invalid_rate(rows(spark, d), registry_ids(table(spark, d, "label_targets"), "technique_id")).withColumn("bad_share", F.round("bad_share", 6))


_ORDER = "(id * 7919) % 104729"


@query(f"WITH {ROWS}, ranked AS (SELECT id, tag, row_number() OVER (PARTITION BY tag ORDER BY {_ORDER}, id) AS k FROM flat) SELECT id FROM rows WHERE id NOT IN (SELECT id FROM ranked WHERE k > 20)")
def head_cap(spark: SparkSession, d: str) -> DataFrame:
    return labels.head_cap(rows(spark, d), 20, order=(F.col("id") * 7919) % 104729).select("id")


@query(f"WITH {ROWS} SELECT id, round(1 / sqrt(greatest(min(n_rows), 1)), 6) AS weight FROM flat JOIN counts USING (tag) GROUP BY 1")
def inverse_weights(spark: SparkSession, d: str) -> DataFrame:
    own = rows(spark, d)
    return labels.inverse_weights(own, labels.histogram(own)).withColumn("weight", F.round("weight", 6))


@query(f"WITH {ROWS}, s AS (SELECT id, max(n_rows) AS top, min(n_rows) AS least FROM flat JOIN counts USING (tag) GROUP BY 1) SELECT id, (CASE WHEN least < 80 THEN least(12, greatest(1, 80 // top)) ELSE 0 END)::INTEGER AS extra FROM s")
def tail_copies(spark: SparkSession, d: str) -> DataFrame:
    own = rows(spark, d)
    return labels.tail_copies(own, labels.histogram(own))


@query(f"WITH {ROWS}, s AS (SELECT id, min(n_rows) AS least FROM flat JOIN counts USING (tag) GROUP BY 1), t AS (SELECT max(n_rows) AS top FROM counts) SELECT id, least(3, greatest(0, trunc(log2(top / least))::INTEGER - 1))::INTEGER AS extra FROM s, t")
def frequency_copies(spark: SparkSession, d: str) -> DataFrame:
    own = rows(spark, d)
    return labels.frequency_copies(own, labels.histogram(own))


@query(
    f"WITH {ROWS}, w AS (SELECT id, 1 / sqrt(greatest(min(n_rows), 1)) AS weight FROM flat JOIN counts USING (tag) GROUP BY 1), c AS (SELECT id, weight, sum(weight) OVER (ORDER BY id) AS upto, sum(weight) OVER () AS total FROM w), "
    "p AS (SELECT id, floor(upto / total * 1000 + 0.5 - 1e-9) - floor((upto - weight) / total * 1000 + 0.5 - 1e-9) AS n FROM c) SELECT id, n::INTEGER AS copies FROM p WHERE n > 0"
)
def weighted_resample(spark: SparkSession, d: str) -> DataFrame:
    own = rows(spark, d)
    return labels.weighted_resample(labels.inverse_weights(own, labels.histogram(own)), 1000).select("id", "copies")


@query(f"WITH {ROWS}, n AS (SELECT tag FROM flat GROUP BY 1 HAVING count(*) > 1) SELECT id, coalesce(id IN (SELECT id FROM flat WHERE tag IN (FROM n)), false) AS has_partner, coalesce(id IN (SELECT id FROM flat WHERE tag IN (FROM n)), false) AS shares_tag FROM rows")
def label_partners(spark: SparkSession, d: str) -> DataFrame:
    """Whether each row got another row as partner, and whether that one shares a tag with it."""
    own = rows(spark, d)
    found = labels.partner(own).join(own, "id").join(own.select(F.col("id").alias("partner_id"), F.col("tags").alias("theirs")), "partner_id", "left")
    return found.select("id", F.col("partner_id").isNotNull().alias("has_partner"), F.coalesce(F.arrays_overlap("tags", "theirs") & (F.col("id") != F.col("partner_id")), F.lit(False)).alias("shares_tag"))


@query(f"WITH {ROWS}, r AS (SELECT id, row_number() OVER (ORDER BY {_ORDER}, id) AS k, count(*) OVER () AS n FROM rows) SELECT id, CASE WHEN k <= floor(n * 0.15) THEN 'holdout' ELSE 'train' END AS split FROM r")
def holdout_split(spark: SparkSession, d: str) -> DataFrame:
    return labels.holdout(rows(spark, d).select("id"), "id", order=(F.col("id") * 7919) % 104729).select("id", "split")


@query(f"WITH {ROWS} SELECT id, 'Summary: row ' || id || chr(10) || 'Techniques:' AS prompt, '[' || chr(39) || array_to_string(list_sort(tags), chr(39) || ',' || chr(39)) || chr(39) || ']' || chr(10) AS completion FROM rows")
def prompt_rows(spark: SparkSession, d: str) -> DataFrame:
    told = rows(spark, d).withColumn("tags", F.array_sort("tags")).withColumn("s", F.concat(F.lit("row "), F.col("id").cast("string")))
    return labels.prompt_rows(told, "s", "tags").select("id", "prompt", "completion")


@query(f"WITH {ROWS} SELECT id, (CASE WHEN id % 5 = 0 THEN 4 ELSE 1 END)::BIGINT AS n FROM rows")
def shard_rows(spark: SparkSession, d: str) -> DataFrame:
    own = rows(spark, d)
    return labels.shards(own.where("id % 5 <> 0"), own.where("id % 5 = 0")).groupBy("id").agg(F.count("*").alias("n"))


@query(
    f"WITH {ROWS}, t AS (SELECT list(technique_id) AS ok FROM label_targets), m AS (SELECT CASE WHEN split_part(tag, '.', 1) = 'T1190' THEN 'T9999' ELSE tag END AS tag FROM flat), b AS (SELECT NOT (list_contains(ok, tag) OR list_contains(ok, split_part(tag, '.', 1))) AS bad FROM m, t) SELECT count(*) AS n_tags, count(*) FILTER (bad) AS n_bad, round(count(*) FILTER (bad) / count(*), 6) AS bad_share FROM b"
)
def invalid_after_remap(spark: SparkSession, d: str) -> DataFrame:
    from sievemill.operators import gates, remap

    moved = remap.map_column(spark.createDataFrame([("T1190", "T9999")], "old string, new string"))
    known = gates.registry_ids(table(spark, d, "label_targets"), "technique_id")
    return labels.invalid_rate(rows(spark, d), known, mapping=moved).withColumn("bad_share", F.round("bad_share", 6))


PAIRS = (
    r"pairs AS (SELECT mapping_id AS id, list_distinct(list_filter(list_transform(coalesce(mitre_ids, []), lambda x: split_part(upper(trim(x)), '.', 1)), lambda x: regexp_matches(x, '^T\d{4}$'))) AS gold, "
    r"list_distinct(list_transform(regexp_extract_all(coalesce(raw_model_output, ''), '(?i)\bT\d{4}'), lambda x: upper(x))) AS pred FROM (SELECT *, row_number() OVER (PARTITION BY mapping_id ORDER BY mapped_at DESC NULLS LAST) AS k FROM mappings) WHERE k = 1), "
    "g AS (SELECT id, unnest(gold) AS label FROM pairs), p AS (SELECT id, unnest(pred) AS label FROM pairs), j AS (SELECT coalesce(g.label, p.label) AS label, g.id IS NOT NULL AND p.id IS NOT NULL AS tp, g.id IS NULL AS fp, p.id IS NULL AS fn FROM g FULL JOIN p ON g.id = p.id AND g.label = p.label), "
    "l AS (SELECT label, count(*) FILTER (tp) AS tp, count(*) FILTER (fp) AS fp, count(*) FILTER (fn) AS fn FROM j GROUP BY 1)"
)


def pairs(spark: SparkSession, d: str) -> DataFrame:
    """Root ids of a mapping as gold, root ids in its answer as prediction."""
    from sievemill.plans.findings import mapped

    ids = F.transform(F.coalesce("mitre_ids", F.array().cast("array<string>")), lambda t: text.root(F.trim(t)))
    gold = F.array_distinct(F.filter(ids, lambda t: t.rlike(r"^T\d{4}$")))
    pred = F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce("raw_model_output", F.lit("")), F.lit(r"(?i)\bT\d{4}"), F.lit(0)), F.upper))
    return mapped(spark, d, "mitre_ids", "raw_model_output").select(F.col("mapping_id").alias("id"), gold.alias("gold"), pred.alias("pred"))


@query(f"WITH {PAIRS} SELECT label, tp, fp, fn, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1, tp + fn AS support FROM l")
def label_metrics(spark: SparkSession, d: str) -> DataFrame:
    made = metrics.per_label(pairs(spark, d))
    return made.select("label", "tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support")


@query(f"WITH {PAIRS} SELECT round(2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)), 6) AS micro_f1, round(avg(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)), 6) AS macro_f1, count(*) AS n_labels FROM l")
def overall_metrics(spark: SparkSession, d: str) -> DataFrame:
    made = metrics.overall(metrics.per_label(pairs(spark, d)))
    return made.select(F.round("micro_f1", 6).alias("micro_f1"), F.round("macro_f1", 6).alias("macro_f1"), "n_labels")


@query(f"WITH {PAIRS}, c AS (SELECT label, count(*) AS n FROM p GROUP BY 1), t AS (SELECT sum(n) AS total FROM c) SELECT round(max(n) / max(total), 6) AS top_share, count(*) AS n_labels, round(sum(-(n / total) * ln(n / total + 1e-12)), 6) AS entropy FROM c, t")
def prediction_entropy(spark: SparkSession, d: str) -> DataFrame:
    made = metrics.concentration(pairs(spark, d))
    return made.select(F.round("top_share", 6).alias("top_share"), "n_labels", F.round("entropy", 6).alias("entropy"))


@query(
    f"WITH {PAIRS}, a AS (SELECT label, count(*) AS n FROM p GROUP BY 1), b AS (SELECT label, count(*) AS n FROM g GROUP BY 1), u AS (SELECT coalesce(a.n, 0) AS x, coalesce(b.n, 0) AS y FROM a FULL JOIN b USING (label)), s AS (SELECT sum(x) AS sx, sum(y) AS sy, count(*) AS k FROM u) "
    "SELECT round(sum(((x / sx + 1e-12) / (1 + k * 1e-12)) * ln(((x / sx + 1e-12) / (1 + k * 1e-12)) / ((y / sy + 1e-12) / (1 + k * 1e-12)))), 6) AS kl FROM u, s"
)
def prediction_divergence(spark: SparkSession, d: str) -> DataFrame:
    return metrics.divergence(pairs(spark, d)).select(F.round("kl", 6).alias("kl"))


@query(f"WITH {PAIRS}, rare AS (SELECT label FROM g GROUP BY 1 ORDER BY count(*), label LIMIT 10), e AS (SELECT g.id, g.label FROM g WHERE label IN (SELECT label FROM rare)) SELECT count(*) AS n_gold, count(p.id) AS n_hit, round(count(p.id) / count(*), 6) AS recall FROM e LEFT JOIN p ON p.id = e.id AND p.label = e.label")
def tail_recall(spark: SparkSession, d: str) -> DataFrame:
    own = pairs(spark, d)
    rare = labels.rarest(metrics.label_counts(own, "gold"), 10, "label", "n")
    return metrics.tail_recall(own, rare).withColumn("recall", F.round("recall", 6))


@query(f"WITH {PAIRS}, t AS (SELECT count(*) AS n FROM p GROUP BY label ORDER BY n DESC, label LIMIT 40), s AS (SELECT avg(n) AS e, count(*) AS k FROM t) SELECT round(sum((n - e) ** 2 / e), 4) AS chi2, max(k) - 1 AS df FROM t, s")
def label_uniformity(spark: SparkSession, d: str) -> DataFrame:
    made = metrics.uniformity(metrics.label_counts(pairs(spark, d), "pred"))
    return made.select(F.round("chi2", 4).alias("chi2"), "df")


@query(f"WITH {PAIRS}, a AS (SELECT label, count(*) AS n FROM g GROUP BY 1), b AS (SELECT label, count(*) AS n FROM p GROUP BY 1) SELECT coalesce(a.label, b.label) AS label, coalesce(a.n, 0) AS n_gold, coalesce(b.n, 0) AS n_pred FROM a FULL JOIN b ON a.label = b.label ORDER BY coalesce(a.n, 0) + coalesce(b.n, 0) DESC, 1 LIMIT 20")
def label_marginals(spark: SparkSession, d: str) -> DataFrame:
    return metrics.marginals(pairs(spark, d))


TWICE = (
    r"one AS (SELECT finding_id, mapping_id, list_distinct(list_filter(list_transform(coalesce(mitre_ids, []), lambda x: split_part(upper(trim(x)), '.', 1)), lambda x: regexp_matches(x, '^T\d{4}$'))) AS ids FROM "
    "(SELECT *, row_number() OVER (PARTITION BY mapping_id ORDER BY mapped_at DESC NULLS LAST) AS k FROM mappings) WHERE k = 1), "
    "twice AS (SELECT finding_id AS id, arg_min(ids, mapping_id) AS gold, arg_max(ids, mapping_id) AS pred FROM one GROUP BY 1), tg AS (SELECT id, unnest(gold) AS label FROM twice), tp AS (SELECT id, unnest(pred) AS label FROM twice)"
)


def twice(spark: SparkSession, d: str) -> DataFrame:
    """The first mapping of a finding as gold, its last as prediction; a finding mapped once agrees with itself."""
    from sievemill.plans.findings import mapped

    roots = F.transform(F.coalesce("mitre_ids", F.array().cast("array<string>")), lambda t: text.root(F.trim(t)))
    one = mapped(spark, d, "finding_id", "mitre_ids").withColumn("ids", F.array_distinct(F.filter(roots, lambda t: t.rlike(r"^T\d{4}$"))))
    return one.groupBy(F.col("finding_id").alias("id")).agg(F.min_by("ids", "mapping_id").alias("gold"), F.max_by("ids", "mapping_id").alias("pred"))


@query(f"WITH {TWICE}, m AS (SELECT id, label FROM tg EXCEPT SELECT id, label FROM tp), w AS (SELECT id, label FROM tp EXCEPT SELECT id, label FROM tg) SELECT m.label AS missed, w.label AS given, count(*) AS n_rows FROM m JOIN w USING (id) GROUP BY 1, 2")
def label_confusion(spark: SparkSession, d: str) -> DataFrame:
    return metrics.confusion(twice(spark, d))


@query(
    f"WITH {TWICE}, s AS (SELECT id, substr(id, 1, 1) IN ('0','1','2','3','4','5','6','7') AS low FROM twice), j AS (SELECT coalesce(tg.id, tp.id) AS id, coalesce(tg.label, tp.label) AS label, tg.id IS NOT NULL AND tp.id IS NOT NULL AS tp, tg.id IS NULL AS fp, tp.id IS NULL AS fn FROM tg FULL JOIN tp ON tg.id = tp.id AND tg.label = tp.label), "
    "l AS (SELECT low, label, count(*) FILTER (tp) AS tp, count(*) FILTER (fp) AS fp, count(*) FILTER (fn) AS fn FROM j JOIN s USING (id) GROUP BY 1, 2) SELECT low, round(2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)), 6) AS micro_f1, round(avg(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)), 6) AS macro_f1, count(*) AS n_labels FROM l GROUP BY 1"
)
def group_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Metrics of two groups side by side, as of a hold-out and the rest or of two models."""
    rows = twice(spark, d).withColumn("low", F.substring("id", 1, 1).isin(list("01234567")))
    made = metrics.overall(metrics.per_label(rows, group=["low"]), group=["low"])
    return made.select("low", F.round("micro_f1", 6).alias("micro_f1"), F.round("macro_f1", 6).alias("macro_f1"), "n_labels")


@query(f"WITH {PAIRS} SELECT count(*) AS n_rows, count(*) FILTER (len(pred) = 0) AS n_empty, count(*) FILTER (len(pred) = 1 AND pred[1] IN ('T1190', 'T1078', 'T1059', 'T1021', 'T1046') AND NOT list_has_any(gold, pred)) AS n_common_wrong FROM pairs")
def prediction_failures(spark: SparkSession, d: str) -> DataFrame:
    return metrics.failures(pairs(spark, d), ["T1190", "T1078", "T1059", "T1021", "T1046"])
