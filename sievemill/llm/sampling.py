"""Problem 1: a sample that follows target shares of categories.

Systematic unequal-probability sampling. Each category gets an expected size from its share, its floor and what exists:
its share of the asked size at least, so floors come on top and never starve a category without one; only what some
categories lack is spread over the others. A member's inclusion probability is expected / available. Members are range-partitioned by category and a random hash,
so a category of any size spreads over many partitions. Probabilities are prefix-summed within partitions and across
them (the driver holds one number per partition), one random start fixes the grid, and members whose interval holds a
grid point are drawn. A category therefore gets its expected size rounded up or down; floors missed by rounding are
repaired with its next members in hash order.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievemill.llm.common import cut, latest

#: The target table comes to the driver; more rows than this are an error.
MAX_CATEGORIES = 100_000


@dataclass
class Sample:
    rows: DataFrame  # id, category
    report: DataFrame


def first_category(ids: Column) -> Column:
    """First id neither null nor blank, trimmed, upper-cased and cut before the first dot; null if there is none."""
    clean = F.transform(ids, lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))
    first = F.get(F.filter(clean, lambda x: x.isNotNull() & (x != "")), F.lit(0))
    return F.split_part(F.upper(first), F.lit("."), F.lit(1))


def expected_sizes(shares: np.ndarray, floors: np.ndarray, available: np.ndarray, size: float) -> np.ndarray:
    """Sizes within [floor, available], proportional to the shares: at least share x size, more where others lack members.

    They sum to `size`, to less where too little exists, and to more where floors ask for it.
    """
    low, high = np.minimum(floors, available), available.astype(float)
    at = lambda scale: np.clip(scale * shares * size, low, high)
    if not len(shares) or at(1.0).sum() >= size:
        return at(1.0) if len(shares) else low.astype(float)
    left, right = 1.0, 2.0
    while at(right).sum() < size and right < 1e12:
        right *= 2
    for _ in range(200):
        middle = (left + right) / 2
        left, right = (middle, right) if at(middle).sum() < size else (left, middle)
    return at(right)


def _draw(offsets: dict[int, float], start: float):
    """Marks the rows whose interval of the running probability holds a point of the unit grid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: float | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            p = batch.column("p").to_numpy()
            if at is None:
                at = offsets[batch.column("part")[0].as_py()]
            edge = at + np.r_[0.0, np.cumsum(p)] + start
            drawn = np.floor(edge[1:] + 1e-9) > np.floor(edge[:-1] + 1e-9)
            at = float(edge[-1] - start)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("category"), batch.column("r"), pa.array(drawn)], names=["id", "category", "r", "drawn"])

    return run


def draw(records: DataFrame, ident: str, category: Column, targets: DataFrame, *, order: str | None = None, key: str = "technique_id", one_in: int = 10, seed: int = 11) -> Sample:
    """Sample of about one in `one_in` of the records that have a category.

    `targets` holds `key`, `target_share` and `min_rows`; null shares and floors count as 0 and repeated keys once, by
    their greatest values. A record counts once, by its delivery latest in `order`; records with a null id or no
    category take no part, and categories outside `targets` are counted but never drawn. The report has one row per
    target and speaks of the rows drawn: `met` is false where they are fewer than the floor, or than share x asked size
    rounded down, or are all there is and still below it; `short_of` says which. `share_met` tells whether the share of
    the sample is the target to within a row; floors that add up to more than the size, or others' lack, can shift it.
    Empty inputs give an empty sample and a full report.
    """
    spark = records.sparkSession
    at = F.col(order) if order else F.lit(None).cast("timestamp")
    known = latest(records.select(F.col(ident).alias("id"), at.alias("at"), category.alias("category")), ["id"], ["at"], ["category"]).where("category IS NOT NULL")
    known = cut(known)
    wanted = targets.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("category")).agg(F.coalesce(F.max("target_share"), F.lit(0.0)).alias("share"), F.coalesce(F.max("min_rows"), F.lit(0)).alias("least")).orderBy("category").limit(MAX_CATEGORIES + 1).collect()
    if len(wanted) > MAX_CATEGORIES:
        raise ValueError(f"more than {MAX_CATEGORIES} categories in the targets")
    goals = spark.createDataFrame([(w.category, float(w.share), int(w.least)) for w in wanted], "category string, share double, least int")
    total = known.count()
    counted = {r.category: r.n for r in known.groupBy("category").agg(F.count("*").alias("n")).join(F.broadcast(goals), "category").select("category", "n").collect()}  # at most MAX_CATEGORIES
    size = total / one_in
    shares = np.array([w.share for w in wanted], float)
    floors = np.array([w.least for w in wanted], float)
    available = np.array([counted.get(w.category, 0) for w in wanted], float)
    expected = expected_sizes(shares, floors, available, size)

    chances = [(w.category, float(min(1.0, e / a))) for w, e, a in zip(wanted, expected, available, strict=True) if a > 0]
    p = spark.createDataFrame(chances, "category string, p double")
    chosen = known.join(F.broadcast(p), "category").select("id", "category", F.xxhash64("id", F.lit(seed)).alias("r"), "p")
    ordered = cut(chosen.repartitionByRange("category", "r").sortWithinPartitions("category", "r", "id"))
    numbered = ordered.withColumn("part", F.spark_partition_id())
    mass = {r.part: r.p for r in numbered.groupBy("part").agg(F.sum("p").alias("p")).collect()}  # a row per partition
    offsets, run = {}, 0.0
    for part in sorted(mass):
        offsets[part] = run
        run += mass[part]
    start = float(np.random.default_rng(seed).random())
    marked = numbered.mapInArrow(_draw(offsets, start), "id {0}, category string, r long, drawn boolean".format(known.schema["id"].dataType.simpleString()))
    marked = cut(marked)
    got = {r.category: r.n for r in marked.where("drawn").groupBy("category").agg(F.count("*").alias("n")).collect()}  # at most MAX_CATEGORIES
    missing = [(w.category, int(min(w.least, a)) - got.get(w.category, 0)) for w, a in zip(wanted, available, strict=True)]
    missing = [(c, n) for c, n in missing if n > 0]
    rows = marked.where("drawn").select("id", "category")
    if missing:
        lack = spark.createDataFrame(missing, "category string, lack int")
        spare = marked.where("NOT drawn").join(F.broadcast(lack), "category")
        # row_number below a limit is cut to the first rows of each partition before the shuffle
        more = spare.withColumn("n", F.row_number().over(Window.partitionBy("category").orderBy("r", "id"))).where(F.col("n") <= max(n for _, n in missing)).where("n <= lack")
        rows = rows.unionByName(more.select("id", "category"))
        for c, n in missing:
            got[c] = got.get(c, 0) + n
    drawn = sum(got.values())
    told = []
    for w, e, a in zip(wanted, expected, available, strict=True):
        want, n = w.share * size, got.get(w.category, 0)
        few = n <= want - 1 or (n == a and n < want)
        below = n < w.least
        reason = "share and floor" if few and below else "share" if few else "floor" if below else None
        share = n / drawn if drawn else None
        told.append((w.category, float(w.share), int(w.least), int(a), float(want), float(e), n, share, bool(not few and not below), reason, bool(drawn and abs(n - w.share * drawn) <= 1)))
    schema = f"{key} string, target_share double, min_rows int, available long, wanted_rows double, expected_rows double, drawn_rows long, actual_share double, met boolean, short_of string, share_met boolean"
    return Sample(rows, spark.createDataFrame(told, schema))
