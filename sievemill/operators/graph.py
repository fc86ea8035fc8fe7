"""Property graph tables: vendor(name), control(control_id, ...), mitre(technique_id), provides, mitigates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemill.functions import text
from sievemill.operators.common import keep_first, latest


def upsert(stored: DataFrame, incoming: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The latest incoming row per key over the stored one; a null incoming value leaves the stored value."""
    new = latest(incoming, [key], order).select(*stored.columns)
    n, s = new.alias("n"), stored.alias("s")
    joined = s.join(n, F.col(f"s.{key}") == F.col(f"n.{key}"), "full_outer")
    return joined.select(*[F.coalesce(F.col(f"n.{c}"), F.col(f"s.{c}")).alias(c) for c in stored.columns])


def upsert_edges(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Edges are only ever added."""
    return stored.unionByName(incoming.select(*stored.columns)).distinct()


def technique_edges(controls: DataFrame, control: str = "control_id", techniques: str = "mitre_ids") -> DataFrame:
    ids = F.explode(F.array_distinct(F.filter(F.transform(techniques, lambda t: F.upper(text.strip(t))), lambda t: t.isNotNull() & (t != ""))))
    return controls.select(control, ids.alias("technique_id")).distinct()


def violations(df: DataFrame, key: str) -> DataFrame:
    """Keys that are not unique."""
    return df.groupBy(key).agg(F.count("*").alias("n_rows")).where("n_rows > 1")


def undirected_key(a: str, b: str) -> Column:
    return F.concat_ws("\0", F.least(a, b), F.greatest(a, b))


def export(provides: DataFrame, controls: DataFrame, mitigates: DataFrame) -> DataFrame:
    """vendor_name, control_id, description, mitre_ids (sorted) of every provided control; techniques are optional."""
    ids = mitigates.groupBy("control_id").agg(F.array_sort(F.collect_set("technique_id")).alias("mitre_ids"))
    joined = provides.join(controls, "control_id").join(ids, "control_id", "left")
    return joined.select("vendor_name", "control_id", "description", F.coalesce("mitre_ids", F.array().cast("array<string>")).alias("mitre_ids"))


def nodes_and_links(rows: DataFrame, vendor: str = "vendor_name", control: str = "control_id", steps: str = "description", ids: str = "mitre_ids") -> tuple[DataFrame, DataFrame]:
    """Nodes (id, group, label, description) and links (source, target) of export rows; the first of a node id wins."""
    name = F.coalesce(text.blank_to_null(vendor), F.lit("unknown"))
    framework = text.slug(name)
    item = text.node_id(name, F.coalesce(control, F.lit("")))
    tags = F.explode(F.array_distinct(F.filter(F.coalesce(ids, F.array().cast("array<string>")), lambda t: t.isNotNull() & (t != ""))))
    none = F.lit(None).cast("string")
    made = rows.select(framework.alias("id"), F.lit("Framework").alias("group"), name.alias("label"), none.alias("description"))
    made = made.unionByName(rows.select(item.alias("id"), F.lit("Control").alias("group"), F.col(control).alias("label"), text.truncate(steps, 2000).alias("description")))
    made = made.unionByName(rows.select(tags.alias("id")).select("id", F.lit("MITRE").alias("group"), F.col("id").alias("label"), none.alias("description")))
    nodes = keep_first(made, ["id"], [F.col("group"), F.col("label"), F.col("description")])
    links = rows.select(framework.alias("source"), item.alias("target")).unionByName(rows.select(item.alias("source"), tags.alias("target"))).distinct()
    return nodes, links


def attach_orphans(techniques: DataFrame, links: DataFrame, controls: DataFrame) -> DataFrame:
    """A synthetic link for each technique without one, round robin over the controls.

    Both sides are numbered by one count over their partitions, not by a window over all rows.
    """
    lone = techniques.select(F.col("technique_id").alias("target")).distinct().join(links.select("target").distinct(), "target", "left_anti")
    n = controls.select("control_id").distinct().count()
    if not n:
        return links.select("source", "target").limit(0)
    left = numbered(lone, "target").withColumn("place", F.col("number") % n)
    right = numbered(controls.select(F.col("control_id").alias("source")).distinct(), "source").withColumnRenamed("number", "place")
    return left.join(right, "place").select("source", "target")


def numbered(df: DataFrame, key: str, name: str = "number") -> DataFrame:
    """Rows numbered from 0 in order of a unique key: range partitions, counted, with offsets per partition.

    The sorted rows are kept in the shared checkpoint folder, so that both passes see the same partitions.
    """
    from sievemill.operators.state import checkpointed

    laid = checkpointed(df.repartitionByRange(key).sortWithinPartitions(key)).withColumn("_p", F.spark_partition_id())
    counts = {r["_p"]: r["n"] for r in laid.groupBy("_p").agg(F.count("*").alias("n")).collect()}  # a row per partition
    at, starts = 0, []
    for p in sorted(counts):
        starts.append((p, at))
        at += counts[p]
    before = df.sparkSession.createDataFrame(starts, "_p int, _before long")
    within = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return laid.withColumn("_in", within).join(F.broadcast(before), "_p").withColumn(name, F.col("_before") + F.col("_in")).drop("_p", "_in", "_before")


def neighbourhood(vendors: DataFrame, provides: DataFrame, mitigates: DataFrame) -> DataFrame:
    """vendor_name, node, hops: controls at one step and their techniques at two."""
    one = vendors.select("vendor_name").distinct().join(provides, "vendor_name").select("vendor_name", "control_id").distinct()
    two = one.join(mitigates, "control_id").select("vendor_name", F.col("technique_id").alias("node"), F.lit(2).alias("hops"))
    return one.select("vendor_name", F.col("control_id").alias("node"), F.lit(1).alias("hops")).unionByName(two).distinct()


def dense_fixture(spark: SparkSession, frameworks: int = 15, controls: int = 15, techniques: int = 40) -> tuple[DataFrame, DataFrame]:
    """Deterministic graph by modular arithmetic, for tests."""
    ids = spark.range(frameworks * controls)
    f, c = (F.col("id") / controls).cast("int"), F.col("id") % controls
    control = F.format_string("F%02d-C%02d", f, c.cast("int"))
    nodes = ids.select(control.alias("control_id"), F.format_string("Framework %02d", f).alias("vendor_name"))
    edge = F.explode(F.array(*[(F.col("id") * k + k) % techniques for k in (3, 7)]))
    links = ids.select(control.alias("control_id"), edge.alias("t")).select("control_id", F.format_string("T%04d", (F.col("t") + 1000).cast("int")).alias("technique_id")).distinct()
    return nodes, links


def nested_controls(groups: DataFrame) -> DataFrame:
    """Pre-order rows (path, control_id, title, prose) of OSCAL groups given as JSON text in `group`.

    Depth follows the data: a JSON walk in an Arrow batch, one group at a time, not a fixed number of joins.
    """
    import pandas as pd

    def run(frames):
        import json

        for frame in frames:
            out = []

            def walk(control: dict, path: str) -> None:
                out.append((path, control.get("id"), control.get("title"), "\n".join(prose(control.get("parts") or []))))
                for i, child in enumerate(control.get("controls") or []):
                    walk(child, f"{path}.{i:04d}")

            def prose(parts: list) -> list[str]:
                found = []
                for part in parts:
                    if part.get("prose"):
                        found.append(part["prose"])
                    found += prose(part.get("parts") or [])
                return found

            for g, raw in enumerate(frame["group"]):
                for i, control in enumerate((json.loads(raw) if raw else {}).get("controls") or []):
                    walk(control, f"{g:06d}.{i:04d}")
            yield pd.DataFrame(out, columns=["path", "control_id", "title", "prose"])

    return groups.select("group").mapInPandas(run, "path string, control_id string, title string, prose string")


def control_records(nested: DataFrame, mapping: DataFrame) -> DataFrame:
    """key, control_id, remediation, mitre_ids of controls with text, joined with what they mitigate.

    `mapping` has capability_id, attack_object_id, mapping_type; only `mitigates` with both ids counts.
    """
    good = mapping.where("mapping_type = 'mitigates' AND capability_id IS NOT NULL AND attack_object_id IS NOT NULL")
    per_key = good.groupBy(text.control_key("capability_id").alias("key")).agg(F.array_sort(F.collect_set("attack_object_id")).alias("mitre_ids"))
    body = text.without_placeholders("prose")
    rows = nested.where(body != "").select(text.control_key("control_id").alias("key"), F.concat_ws("\n\n", text.blank_to_null("title"), body).alias("remediation"))
    return rows.join(per_key, "key", "left").select("key", F.concat(F.lit("NIST-"), "key").alias("control_id"), "remediation", F.coalesce("mitre_ids", F.array().cast("array<string>")).alias("mitre_ids"))
