"""Problem 3: the same or nearly the same records across splits.

Texts of the train split and of all other splits are signed, banded and verified together (see `neardup`); a bucket only
gives pairs with one member on each side, so duplicates inside a split never leave it. Confirmed class pairs are widened
to records by joining the train members to the one class and the other members to the other.

A record counts once, by its delivery latest in `added_at`. Split names compare in lower case; a null split and a text
with fewer than `min_words` distinct words (null and empty texts too) take no part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievemill.llm.common import latest
from sievemill.llm.neardup import NearDuplicates, find

TRAIN, OTHER = 1, 2


def _side():
    split = F.lower("split_name")
    return F.when(split == "train", F.lit(TRAIN)).when(split.isNotNull(), F.lit(OTHER))


def cross_split(reports: DataFrame, *, threshold: float = 0.7, min_words: int = 10) -> NearDuplicates:
    return find(reports, "report_id", F.col("technical_summary"), threshold=threshold, min_words=min_words, order="added_at", side=_side())


def record_pairs(found: NearDuplicates) -> DataFrame:
    """train_id, other_id, jaccard for every confirmed pair of a train record and a record of another split."""
    one_way = found.links.select("class_a", "class_b", "jaccard")
    back = found.links.select(F.col("class_b").alias("class_a"), F.col("class_a").alias("class_b"), "jaccard")
    own = found.classes.where(F.col("side") == (TRAIN | OTHER)).select(F.col("class_id").alias("class_a"), F.col("class_id").alias("class_b"), F.lit(1.0).alias("jaccard"))
    edges = one_way.unionByName(back).unionByName(own)
    train = found.members.where(F.col("side") == TRAIN).select(F.col("class_id").alias("class_a"), F.col("id").alias("train_id"))
    other = found.members.where(F.col("side") == OTHER).select(F.col("class_id").alias("class_b"), F.col("id").alias("other_id"))
    return edges.join(train, "class_a").join(other, "class_b").select("train_id", "other_id", "jaccard")


def id_pairs(found: NearDuplicates) -> DataFrame:
    return record_pairs(found).select(F.least("train_id", "other_id").alias("report_id_a"), F.greatest("train_id", "other_id").alias("report_id_b"))


def report(reports: DataFrame, found: NearDuplicates) -> DataFrame:
    """Per split and source of the evaluation record: records, overlapping records, pairs and how many agree in labels.

    Labels agree when both records hold the same set of ids, trimmed and upper-cased without nulls and blanks; a null
    list is an empty set.
    """
    labels = F.array_sort(F.array_distinct(F.filter(F.transform(F.coalesce("mitre_ids", F.array().cast("array<string>")), lambda x: F.upper(F.trim(x))), lambda x: x.isNotNull() & (x != ""))))
    known = latest(
        reports.select("report_id", "added_at", F.lower("split_name").alias("split"), F.lower(F.trim("source_name")).alias("source"), F.array_join(labels, ",").alias("labels")), ["report_id"], ["added_at"], ["split", "source", "labels"]
    )
    pairs = record_pairs(found)
    train = known.select(F.col("report_id").alias("train_id"), F.col("labels").alias("train_labels"))
    per_record = (
        pairs.join(train, "train_id")
        .join(known.select(F.col("report_id").alias("other_id"), "labels"), "other_id")
        .groupBy("other_id")
        .agg(F.count("*").alias("pairs"), F.max((F.col("jaccard") == 1).cast("int")).alias("exact"), F.sum((F.col("labels") == F.col("train_labels")).cast("int")).alias("agreeing"))
    )
    rows = known.where("split IS NOT NULL AND split <> 'train'").join(per_record.withColumnRenamed("other_id", "report_id"), "report_id", "left")
    return rows.groupBy("split", "source").agg(
        F.count("*").alias("records"),
        F.count("pairs").alias("overlapping"),
        F.coalesce(F.sum("exact"), F.lit(0)).alias("same_words"),
        F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs"),
        F.coalesce(F.sum("agreeing"), F.lit(0)).alias("pairs_same_labels"),
        F.count(F.when(F.col("pairs") > F.col("agreeing"), 1)).alias("records_with_other_labels"),
    )
