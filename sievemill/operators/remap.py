"""Technique id normalisation through a deprecation map."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievemill.functions import text
from sievemill.operators.common import keep_first
from sievemill.operators.gates import known

HOPS = 8


def deprecations(objects: DataFrame) -> DataFrame:
    """old, new technique id pairs from STIX rows (type, id, technique_id, relationship_type, source_ref, target_ref)."""
    pattern = objects.where("type = 'attack-pattern' AND technique_id IS NOT NULL").select("id", "technique_id")
    revoked = objects.where("type = 'relationship' AND relationship_type = 'revoked-by'").select("source_ref", "target_ref")
    source = pattern.select(F.col("id").alias("source_ref"), F.upper("technique_id").alias("old"))
    target = pattern.select(F.col("id").alias("target_ref"), F.upper("technique_id").alias("new"))
    return revoked.join(source, "source_ref").join(target, "target_ref").where("old <> new").select("old", "new").distinct()


def closed(pairs: DataFrame, hops: int = HOPS) -> DataFrame:
    """old and where up to `hops` steps lead; a chain that ends earlier stays at its end. The map is small by nature."""
    one = keep_first(pairs, ["old"], [F.col("new")]).select("old", "new")
    step = one.select(F.col("old").alias("_old"), F.col("new").alias("_next"))
    at = one
    for _ in range(hops - 1):
        at = at.join(step, at["new"] == step["_old"], "left").select("old", F.coalesce("_next", "new").alias("new"))
    return at


def map_column(pairs: DataFrame, most: int = 100_000) -> Column:
    """The closed map as a literal; longer maps are an error, join them instead."""
    rows = closed(pairs).orderBy("old").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"the map holds more than {most} ids")
    return F.create_map(*[F.lit(x) for r in rows for x in (r.old, r.new)]) if rows else F.from_json(F.lit("{}"), "map<string,string>")


def remapped(t: Column, mapping: Column) -> Column:
    """The id through the map, by itself first, else by its root."""
    upper = F.upper(text.strip(t))
    return F.coalesce(mapping[upper], mapping[text.root(upper)], upper)


def normal_tags(tags: Column | str, mapping: Column, allowed: list[str], most: int = 5, *, by_root: bool = True, ordered: bool = True) -> Column:
    """Ids through the map, allowed by themselves or (`by_root`) their root, distinct in order, the first few, sorted by root and id if `ordered`."""
    ids = F.transform(F.coalesce(text.col(tags), F.array().cast("array<string>")), lambda t: remapped(t, mapping))
    good = F.filter(ids, lambda t: F.startswith(t, F.lit("T")) & (known(t, allowed) if by_root else t.isin(allowed)))
    first = F.slice(F.array_distinct(good), 1, most)
    return first if not ordered else F.transform(F.array_sort(F.transform(first, lambda t: F.struct(text.root(t).alias("r"), t.alias("t")))), lambda s: s["t"])


def with_parent(t: Column, allowed: list[str]) -> Column:
    """The id if allowed, else its root if that is, else null."""
    return F.when(t.isin(allowed), t).when(text.root(t).isin(allowed), text.root(t))


def allowed_rows(df: DataFrame, key: str, allowed: DataFrame, allowed_key: str) -> DataFrame:
    """Rows whose id or root is in the list (semi-join on both)."""
    ids = allowed.select(F.upper(allowed_key).alias("_a")).distinct()
    keyed = df.withColumn("_full", F.upper(key)).withColumn("_root", text.root(key))
    full = keyed.join(ids, keyed["_full"] == ids["_a"], "left_semi")
    rest = keyed.join(ids, keyed["_full"] == ids["_a"], "left_anti").join(ids, F.col("_root") == ids["_a"], "left_semi")
    return full.unionByName(rest).drop("_full", "_root")
