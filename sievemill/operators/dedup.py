"""Record de-duplication by content keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievemill.functions import text
from sievemill.operators.common import keep_first


def content_key(summary: str, ids: str) -> Column:
    """SHA-256 of the collapsed text and the sorted ids."""
    return F.sha2(F.concat_ws("\x01", text.collapse(F.coalesce(summary, F.lit(""))), F.array_join(F.array_sort(text.normal_ids(ids)), ",")), 256)


def seed_records(records: DataFrame, *, summary: str, ids: str, local: Column, order: list[Column]) -> DataFrame:
    """One record per text and ids: a local one if there is any, else the first; blank texts and rows without ids go."""
    good = records.where((text.safe_str(summary) != "") & (F.size(text.normal_ids(ids)) > 0))
    keyed = good.withColumn("_key", content_key(summary, ids)).withColumn("_local", local)
    return keep_first(keyed, ["_key"], [F.col("_local").desc(), *order]).drop("_key", "_local")


def by_content(rows: DataFrame, columns: list[str], order: list[Column]) -> DataFrame:
    """The first row of each distinct content; nulls count as equal."""
    return keep_first(rows, columns, order)


def union_seeds(*parts: DataFrame) -> DataFrame:
    """Seed records in order of their parts."""
    made = None
    for i, part in enumerate(parts):
        p = part.withColumn("part", F.lit(i))
        made = p if made is None else made.unionByName(p, allowMissingColumns=True)
    return made
