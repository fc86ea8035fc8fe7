"""Multi-label rows: statistics, rebalancing, splits. Rows are (id, tags array<string>)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievemill.operators.common import keep_first, small, top_n


def flat(rows: DataFrame, ident: str = "id", tags: str = "tags") -> DataFrame:
    """One row per id and distinct tag."""
    return rows.select(F.col(ident).alias("id"), F.explode(F.array_distinct(tags)).alias("tag"))


def histogram(rows: DataFrame, ident: str = "id", tags: str = "tags") -> DataFrame:
    return flat(rows, ident, tags).groupBy("tag").agg(F.count("*").alias("n_rows"))


def most_common(counts: DataFrame, n: int, key: str = "tag", count: str = "n_rows") -> DataFrame:
    return counts.orderBy(F.desc(count), key).limit(n)


def rarest(counts: DataFrame, n: int, key: str = "tag", count: str = "n_rows") -> DataFrame:
    return counts.orderBy(count, key).limit(n)


def co_occurrence(rows: DataFrame, n: int = 28) -> DataFrame:
    """tag_a, tag_b, n_rows over the n most common tags, both directions; pairs are made inside a row, without a join."""
    top = F.broadcast(most_common(histogram(rows), n).select("tag"))  # n rows
    kept = flat(rows).join(top, "tag").groupBy("id").agg(F.array_sort(F.collect_set("tag")).alias("tags")).where(F.size("tags") > 1)
    pair = F.explode(F.flatten(F.transform("tags", lambda a: F.transform(F.filter("tags", lambda b: b != a), lambda b: F.struct(a.alias("tag_a"), b.alias("tag_b"))))))
    return kept.select(pair.alias("p")).groupBy("p.tag_a", "p.tag_b").agg(F.count("*").alias("n_rows"))


def cardinality(rows: DataFrame, tags: str = "tags") -> DataFrame:
    return rows.groupBy(F.coalesce(F.size(tags), F.lit(0)).alias("n_tags")).agg(F.count("*").alias("n_rows"))


def cardinality_stats(rows: DataFrame, tags: str = "tags") -> DataFrame:
    size = F.greatest(F.coalesce(F.size(tags), F.lit(0)), F.lit(0))
    return rows.agg(F.avg(size).alias("mean_tags"), F.max(size).alias("max_tags"), F.count("*").alias("n_rows"))


def invalid_rate(rows: DataFrame, valid: list[str], tags: str = "tags", mapping: Column | None = None, first: int | None = None) -> DataFrame:
    """Tags, how many are not in the valid list by id or root, and the ratio.

    Ids go through the deprecation map first if one is given; `first` looks at so many rows only, by id.
    """
    from sievemill.operators.gates import known
    from sievemill.operators.remap import remapped

    looked = rows.orderBy("id").limit(first) if first else rows
    each = looked.select(F.explode(tags).alias("tag"))
    tag = remapped(F.col("tag"), mapping) if mapping is not None else F.col("tag")
    return each.agg(F.count("*").alias("n_tags"), F.count_if(F.col("tag").isNull() | ~known(tag, valid)).alias("n_bad")).withColumn("bad_share", F.try_divide("n_bad", "n_tags"))


def order_hash(ident: str, seed: int) -> Column:
    return F.xxhash64(ident, F.lit(seed))


def head_cap(rows: DataFrame, cap: int, seed: int = 0, order: Column | None = None) -> DataFrame:
    """Rows that are in the first `cap` rows, in a random order, of every tag they hold.

    Rows beyond the cap of any of their tags go. The order value of the cap-th row of each tag is found by a rank filter,
    which keeps at most cap rows of a tag per partition before the shuffle, and rows are then compared with it.
    """
    by = order if order is not None else order_hash("id", seed)
    keyed = rows.withColumn("_o", by)
    tagged = keyed.select("id", "_o", F.explode(F.array_distinct("tags")).alias("tag"))
    counts = tagged.groupBy("tag").agg(F.count("*").alias("n"))
    big = small(counts.where(F.col("n") > cap).select("tag"))
    ranked = top_n(tagged.join(big, "tag"), ["tag"], [F.col("_o"), F.col("id")], cap)  # cut to cap rows a partition before the shuffle
    limits = ranked.groupBy("tag").agg(F.max(F.struct("_o", "id")).alias("last"))
    beyond = tagged.join(small(limits), "tag").where(F.struct("_o", "id") > F.col("last")).select("id").distinct()
    return keyed.drop("_o").join(beyond, "id", "left_anti")


def inverse_weights(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """id, weight = 1 / sqrt(rows of the rarest tag)."""
    rare = flat(rows).join(small(counts), "tag").groupBy("id").agg(F.min("n_rows").alias("least"))
    return rare.select("id", (1 / F.sqrt(F.greatest("least", F.lit(1)))).alias("weight"))


def weighted_resample(weighted: DataFrame, n: int, start: float = 0.5) -> DataFrame:
    """id, weight, copies: exactly n draws with replacement, each row in proportion to its weight.

    Systematic resampling: rows in order of id lay their weight, scaled to n, on a line, and own the whole numbers (shifted
    by `start`, 0 to 1) that fall on their part. Running sums are made inside range partitions, whose totals (one number
    each) come to the driver. Rows without a positive weight are never drawn.
    """
    from sievemill.operators.state import checkpointed

    laid = checkpointed(weighted.where("weight > 0").repartitionByRange("id").sortWithinPartitions("id")).withColumn("_p", F.spark_partition_id())
    sums = {r["_p"]: r["w"] for r in laid.groupBy("_p").agg(F.sum("weight").alias("w")).collect()}  # a row per partition
    total = sum(sums[p] for p in sorted(sums))
    if not total:
        return weighted.select("id", "weight", F.lit(0).alias("copies")).limit(0)
    offsets, at = [], 0.0
    for p in sorted(sums):
        offsets.append((p, at))
        at += sums[p]
    before = weighted.sparkSession.createDataFrame(offsets, "_p int, _before double")
    run = F.sum("weight").over(Window.partitionBy("_p").orderBy("id").rowsBetween(Window.unboundedPreceding, 0))
    lined = laid.join(F.broadcast(before), "_p").withColumn("_end", F.col("_before") + run)
    # The same running sums bound neighbours, so every whole number belongs to exactly one row; the last one ends at n.
    last = F.lag("_end").over(Window.partitionBy("_p").orderBy("id"))
    place = lambda c: F.floor(c / total * n + start - 1e-9)
    counted = lined.withColumn("copies", (place(F.col("_end")) - place(F.coalesce(last, F.col("_before")))).cast("int"))
    return counted.where("copies > 0").select("id", "weight", "copies")


def tail_copies(rows: DataFrame, counts: DataFrame, rare: int = 80, most: int = 12) -> DataFrame:
    """Rows with copy numbers: a row with a tag under `rare` rows gets min(most, max(1, rare // its largest count)) more."""
    spread = flat(rows).join(small(counts), "tag").groupBy("id").agg(F.max("n_rows").alias("top"), F.min("n_rows").alias("least"))
    extra = F.when(F.col("least") < rare, F.least(F.lit(most), F.greatest(F.lit(1), F.floor(F.lit(rare) / F.col("top")).cast("int")))).otherwise(0)
    return spread.select("id", extra.cast("int").alias("extra"))


def frequency_copies(rows: DataFrame, counts: DataFrame, most: int = 3) -> DataFrame:
    """extra = min(most, max(0, int(log2(largest / rarest count of the row)) - 1)) with the largest over all tags."""
    top = counts.agg(F.max("n_rows").alias("top"))
    least = flat(rows).join(small(counts), "tag").groupBy("id").agg(F.min("n_rows").alias("least"))
    extra = F.least(F.lit(most), F.greatest(F.lit(0), F.log2(F.col("top") / F.col("least")).cast("int") - 1))
    return least.crossJoin(F.broadcast(top)).select("id", extra.cast("int").alias("extra"))  # one row


def with_copies(rows: DataFrame, extras: DataFrame) -> DataFrame:
    joined = rows.join(extras, "id", "left")
    return joined.select(*rows.columns, F.explode(F.sequence(F.lit(0), F.coalesce("extra", F.lit(0)))).alias("copy_no"))


def partner(rows: DataFrame, seed: int = 0) -> DataFrame:
    """id, partner_id: another row with a common tag; null only where no other row has one of the row's tags.

    Rows of a tag are put into 64 hash buckets and in hash order; each takes the next of its bucket. The buckets spread a
    hot tag over many tasks. The last row of a bucket takes the first row of the tag's next bucket that has rows, the last
    bucket that of the first: at most 64 bucket ends per tag. Null ids and null tags link nothing.
    """
    tagged = flat(rows).where("id IS NOT NULL AND tag IS NOT NULL").withColumn("_o", order_hash("id", seed))
    salted = tagged.withColumn("_b", F.pmod(F.col("_o"), F.lit(64)))
    nxt = F.lead("id").over(Window.partitionBy("tag", "_b").orderBy("_o", "id"))
    inside = salted.withColumn("partner_id", nxt).select("id", "tag", "partner_id")
    place = F.struct("_o", "id")
    ends = salted.groupBy("tag", "_b").agg(F.min(place).alias("head"), F.max(place).alias("tail"))
    ring = Window.partitionBy("tag").orderBy("_b")
    across = ends.select(F.col("tail.id").alias("id"), "tag", F.coalesce(F.lead("head.id").over(ring), F.first("head.id").over(ring)).alias("partner_id"))
    found = inside.unionByName(across).where("partner_id <> id")
    one = keep_first(found, ["id"], [F.col("tag")]).select("id", "partner_id")
    return rows.select("id").join(one, "id", "left")


def context_kind(ident: str, seed: int = 0, contradictory: float = 0.025, snippet: float = 0.18, own: str = "partner") -> Column:
    """`contradictory`, `partner` (or `own`, such as `self` with a snippet share of 0.2) or `none` by a hash of the id."""
    u = F.pmod(order_hash(ident, seed), F.lit(1_000_000)) / 1_000_000
    return F.when(u < contradictory, "contradictory").when(u < contradictory + (1 - contradictory) * snippet, own).otherwise("none")


def hash_split(df: DataFrame, ident: str, share: float = 0.15, seed: int = 0) -> DataFrame:
    """Adds `split`: `holdout` for about that share of the ids, else `train`; the same for any partitioning."""
    u = F.pmod(order_hash(ident, seed), F.lit(1_000_000)) / 1_000_000
    return df.withColumn("split", F.when(u < share, "holdout").otherwise("train"))


def holdout(df: DataFrame, ident: str, share: float = 0.15, order: Column | None = None, seed: int = 0) -> DataFrame:
    """Adds `split`: exactly floor(share x rows) ids are `holdout`, the first by `order` (a hash of the id by default), then id.

    Rows are numbered in that order by a range sort and one count per partition (`graph.numbered`); ids are unique.
    """
    from sievemill.operators.graph import numbered

    by = order if order is not None else order_hash(ident, seed)
    ranked = numbered(df.withColumn("_key", F.struct(by.alias("o"), F.col(ident).alias("i"))), "_key", "_place")
    n = int(df.count() * share)
    return ranked.withColumn("split", F.when(F.col("_place") < n, "holdout").otherwise("train")).drop("_key", "_place")


def shards(base: DataFrame, production: DataFrame, copies: int = 4, *more: DataFrame) -> DataFrame:
    """Base rows, each production row `copies` times and any further rows; order by `order_hash` to shuffle."""
    repeated = production.withColumn("_c", F.explode(F.sequence(F.lit(1), F.lit(copies)))).drop("_c")
    made = base.unionByName(repeated, allowMissingColumns=True)
    for df in more:
        made = made.unionByName(df, allowMissingColumns=True)
    return made


def prompt_rows(rows: DataFrame, summary: str, tags: str) -> DataFrame:
    """prompt and completion text of each row."""
    literal = F.concat(F.lit("['"), F.array_join(tags, "','"), F.lit("']\n"))
    return rows.withColumn("prompt", F.concat(F.lit("Summary: "), F.col(summary), F.lit("\nTechniques:"))).withColumn("completion", literal)
