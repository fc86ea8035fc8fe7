"""The pN_ queries, each over its whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemill.llm import mixing, neardup, overlap, pairs, readlevel, sampling, splitting, tokenizer
from sievemill.llm.common import table


def _sample(spark: SparkSession, d: str) -> sampling.Sample:
    return sampling.draw(table(spark, d, "mappings"), "mapping_id", sampling.first_category(F.col("mitre_ids")), table(spark, d, "label_targets"), order="mapped_at")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _sample(spark, d).report.where("NOT met").select("technique_id")


def p1_sample(spark: SparkSession, d: str) -> DataFrame:
    return _sample(spark, d).rows.select(F.col("id").alias("mapping_id"), F.col("category").alias("technique_id"))


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    return _sample(spark, d).report


def _near(spark: SparkSession, d: str) -> neardup.NearDuplicates:
    text = F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("description", F.lit("")))
    return neardup.find(table(spark, d, "findings"), "finding_id", text, min_words=20, order="ingested_at")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.id_pairs(_near(spark, d), "finding_id_a", "finding_id_b").select("finding_id_a", "finding_id_b")


def p2_classes(spark: SparkSession, d: str) -> DataFrame:
    """Each finding with its class (named by its least finding), the copies in it and the findings alike in all."""
    return neardup.counts(_near(spark, d)).select(F.col("id").alias("finding_id"), F.col("first_id").alias("class_id"), "copies", "n_links")


def p2_groups(spark: SparkSession, d: str) -> DataFrame:
    return neardup.id_groups(_near(spark, d)).withColumnRenamed("id", "finding_id")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return overlap.id_pairs(overlap.cross_split(table(spark, d, "reports")))


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    reports = table(spark, d, "reports")
    return overlap.report(reports, overlap.cross_split(reports))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return pairs.defects(table(spark, d, "mappings"), "mapping_id", "finding_summary", "raw_model_output", order="mapped_at")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_pieces(spark, d).select("pdf_path", "batch_index").distinct()


def p5_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.pieces(table(spark, d, "progress"), table(spark, d, "pdf_pages"))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenizer.encode(table(spark, d, "documents"), ["doc_id"])


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    mixed = mixing.mix(table(spark, d, "documents"), table(spark, d, "source_weights"))
    return mixed.report.where("NOT reachable").select("source")


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "source_weights")).sample


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares(mixing.mix(table(spark, d, "documents"), table(spark, d, "source_weights")))


def _levels(spark: SparkSession, d: str, keep: list[str]) -> DataFrame:
    model, _ = readlevel.train(table(spark, d, "level_examples"))
    return readlevel.score(table(spark, d, "documents"), model, keep=keep)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _levels(spark, d, ["doc_id"]).where("kind = 'prose' AND grade = 4").select("doc_id")


def p8_levels(spark: SparkSession, d: str) -> DataFrame:
    return _levels(spark, d, ["doc_id"])


def p8_profile(spark: SparkSession, d: str) -> DataFrame:
    return readlevel.profile(_levels(spark, d, ["source"]))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_sample, p1_report, p2_found, p2_classes, p2_groups, p3_found, p3_report, p4_found, p5_found, p5_pieces, p6_ids, p7_found, p7_mix, p7_shares, p8_found, p8_levels, p8_profile)}
