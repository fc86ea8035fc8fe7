"""Evaluation of multi-label predictions. Rows are (id, gold array<string>, pred array<string>)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EPS = 1e-12


def per_label(rows: DataFrame, vocabulary: DataFrame | None = None, group: list[str] | None = None) -> DataFrame:
    """tp, fp, fn, precision, recall, f1 and support per label; a ratio over nothing is 0.

    Sets are compared inside each row and exploded with a flag, so there is one aggregation and no join of gold with
    predictions.
    """
    by = group or []
    gold, pred = F.coalesce("gold", F.array().cast("array<string>")), F.coalesce("pred", F.array().cast("array<string>"))
    parts = F.concat(
        F.transform(F.array_intersect(gold, pred), lambda t: F.struct(t.alias("label"), F.lit("tp").alias("kind"))),
        F.transform(F.array_except(pred, gold), lambda t: F.struct(t.alias("label"), F.lit("fp").alias("kind"))),
        F.transform(F.array_except(gold, pred), lambda t: F.struct(t.alias("label"), F.lit("fn").alias("kind"))),
    )
    counted = rows.select(*by, F.explode(parts).alias("p")).groupBy(*by, F.col("p.label").alias("label")).agg(*[F.count_if(F.col("p.kind") == k).alias(k) for k in ("tp", "fp", "fn")])
    if vocabulary is not None:
        counted = vocabulary.select("label").distinct().join(counted, "label", "left").fillna(0, ["tp", "fp", "fn"])
    zero = F.lit(0.0)
    made = counted.withColumn("precision", F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fp")), zero)).withColumn("recall", F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fn")), zero))
    return made.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), zero)).withColumn("support", F.col("tp") + F.col("fn"))


def overall(labels: DataFrame, group: list[str] | None = None) -> DataFrame:
    """Micro and macro F1 over the labels given, those without support included."""
    tp, fp, fn = (F.sum(c) for c in ("tp", "fp", "fn"))
    return labels.groupBy(*(group or [])).agg(F.coalesce(F.try_divide(2 * tp, 2 * tp + fp + fn), F.lit(0.0)).alias("micro_f1"), F.avg("f1").alias("macro_f1"), F.count("*").alias("n_labels"))


def label_counts(rows: DataFrame, side: str) -> DataFrame:
    return rows.select(F.explode(side).alias("label")).groupBy("label").agg(F.count("*").alias("n"))


def concentration(rows: DataFrame, side: str = "pred") -> DataFrame:
    """Share of the most common label, number of labels and entropy (natural logarithm)."""
    counts = label_counts(rows, side)
    total = counts.agg(F.sum("n").alias("total"))
    p = F.col("n") / F.col("total")
    joined = counts.crossJoin(F.broadcast(total))  # one row
    return joined.agg((F.max("n") / F.max("total")).alias("top_share"), F.count("*").alias("n_labels"), F.sum(-p * F.ln(p + EPS)).alias("entropy"))


def divergence(rows: DataFrame) -> DataFrame:
    """KL(pred || gold) of the label shares, smoothed and renormalised over the labels of either side."""
    both = label_counts(rows, "pred").withColumnRenamed("n", "p").join(label_counts(rows, "gold").withColumnRenamed("n", "q"), "label", "full").fillna(0, ["p", "q"])
    sums = both.agg(F.sum("p").alias("sp"), F.sum("q").alias("sq"), F.count("*").alias("k"))
    share = lambda c, s: (F.coalesce(F.try_divide(F.col(c), F.col(s)), F.lit(0.0)) + EPS) / (F.when(F.col(s) > 0, 1.0).otherwise(0.0) + F.col("k") * EPS)
    return both.crossJoin(F.broadcast(sums)).agg(F.sum(share("p", "sp") * F.ln(share("p", "sp") / share("q", "sq"))).alias("kl"))  # one row


def tail_recall(rows: DataFrame, rare: DataFrame) -> DataFrame:
    """Gold occurrences of the rare labels, how many were predicted, and the share (0 without any)."""
    each = rows.select(F.explode("gold").alias("label"), "pred").join(rare.select("label"), "label", "left_semi")
    return each.agg(F.count("*").alias("n_gold"), F.count_if(F.array_contains("pred", F.col("label"))).alias("n_hit")).withColumn("recall", F.coalesce(F.try_divide("n_hit", "n_gold"), F.lit(0.0)))


def uniformity(counts: DataFrame, n: int = 40) -> DataFrame:
    """Chi-square of the n most common labels against equal shares, and its degrees of freedom."""
    top = counts.orderBy(F.desc("n"), "label").limit(n)
    stats = top.agg(F.avg("n").alias("e"), F.count("*").alias("k"))
    return top.crossJoin(F.broadcast(stats)).agg(F.sum((F.col("n") - F.col("e")) ** 2 / F.col("e")).alias("chi2"), (F.max("k") - 1).alias("df"))  # one row


def marginals(rows: DataFrame, n: int = 20) -> DataFrame:
    both = label_counts(rows, "gold").withColumnRenamed("n", "n_gold").join(label_counts(rows, "pred").withColumnRenamed("n", "n_pred"), "label", "full").fillna(0, ["n_gold", "n_pred"])
    return both.orderBy(F.desc(F.col("n_gold") + F.col("n_pred")), "label").limit(n)


def confusion(rows: DataFrame) -> DataFrame:
    """missed, given, n_rows over all pairs of a missed gold label and a wrong prediction of one row."""
    missed, given = F.array_except("gold", "pred"), F.array_except("pred", "gold")
    pair = F.explode(F.flatten(F.transform(missed, lambda a: F.transform(given, lambda b: F.struct(a.alias("missed"), b.alias("given"))))))
    return rows.select(pair.alias("p")).groupBy("p.missed", "p.given").agg(F.count("*").alias("n_rows"))


def failures(rows: DataFrame, common: list[str]) -> DataFrame:
    """Rows without a prediction, and rows with one wrong label from the common ones."""
    lone = (F.size("pred") == 1) & F.get("pred", F.lit(0)).isin(common) & ~F.arrays_overlap("gold", "pred")
    return rows.agg(F.count("*").alias("n_rows"), F.count_if(F.coalesce(F.size("pred"), F.lit(0)) <= 0).alias("n_empty"), F.count_if(lone).alias("n_common_wrong"))
