"""Network anomaly detectors over packet rows (src, dst, proto, dst_port, length, seq).

Counts are partial aggregates per partition, so one busy address moves one row per partition. Distinct ports are a
distinct aggregate with map-side combine on (src, port).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemill.functions import fixed

EVENT = "kind string, severity string, src string, dst string, port int, amount bigint, sample array<int>, order_class int, order_key bigint"


def flow_counts(packets: DataFrame) -> DataFrame:
    return packets.groupBy("src", "dst").agg(F.count("*").alias("n_packets"))


def fan_out(packets: DataFrame, sample: int = 10) -> DataFrame:
    """Distinct destination ports of TCP and UDP per source, with the lowest few."""
    pairs = packets.where("proto IN ('TCP', 'UDP')").select("src", "dst_port").distinct()
    return pairs.groupBy("src").agg(F.count("dst_port").alias("n_ports"), F.slice(F.array_sort(F.collect_set("dst_port")), 1, sample).alias("sample"))


def protocol_counts(packets: DataFrame) -> DataFrame:
    name = F.when(F.col("proto").isin("TCP", "UDP", "ICMP"), F.col("proto")).otherwise("Other")
    return packets.groupBy(name.alias("protocol")).agg(F.count("*").alias("n_packets"))


def port_scans(packets: DataFrame, least: int = fixed.PORT_SCAN_PORTS) -> DataFrame:
    return fan_out(packets).where(F.col("n_ports") >= least)


def floods(packets: DataFrame, least: int = fixed.FLOOD_PACKETS) -> DataFrame:
    return flow_counts(packets).where(F.col("n_packets") >= least)


def suspicious_ports(packets: DataFrame, ports: dict[int, str] | None = None) -> DataFrame:
    """One row per TCP packet to a listed port; `service` names it. The list is a literal map, not a join."""
    listed = ports or fixed.SUSPICIOUS_PORTS
    service = F.create_map(*[F.lit(x) for pair in listed.items() for x in pair])[F.col("dst_port")]
    return packets.where((F.col("proto") == "TCP") & F.col("dst_port").isin(list(listed))).withColumn("service", service)


def large_dns(packets: DataFrame, over: int = 512) -> DataFrame:
    return packets.where((F.col("proto") == "UDP") & (F.col("dst_port") == 53) & (F.col("length") > over))


def events(packets: DataFrame, *, scan_ports: int = fixed.PORT_SCAN_PORTS, flood_packets: int = fixed.FLOOD_PACKETS, ports: dict[int, str] | None = None) -> DataFrame:
    """All detectors as one finding-like table; `order_class`, `order_key` give the order: packets, scans, floods."""
    none_port, none_sample = F.lit(None).cast("int"), F.lit(None).cast("array<int>")

    def shaped(df, kind, severity, src, dst, port, amount, sample, place, key):
        return df.select(F.lit(kind).alias("kind"), F.lit(severity).alias("severity"), src.alias("src"), dst.alias("dst"), port.alias("port"), amount.cast("bigint").alias("amount"), sample.alias("sample"), F.lit(place).alias("order_class"), key.cast("bigint").alias("order_key"))

    c = F.col
    none_text = F.lit(None).cast("string")
    made = shaped(suspicious_ports(packets, ports), "suspicious_port", "medium", c("src"), c("dst"), c("dst_port"), F.lit(1), none_sample, 0, c("seq"))
    made = made.unionByName(shaped(large_dns(packets), "large_dns_query", "low", c("src"), c("dst"), F.lit(53), c("length"), none_sample, 0, c("seq")))
    made = made.unionByName(shaped(port_scans(packets, scan_ports), "port_scan", "high", c("src"), none_text, none_port, c("n_ports"), c("sample"), 1, F.lit(0)))
    return made.unionByName(shaped(floods(packets, flood_packets), "connection_flood", "medium", c("src"), c("dst"), none_port, c("n_packets"), none_sample, 2, F.lit(0)))


def events_or_summary(packets: DataFrame, **options) -> DataFrame:
    """The detector rows, or one `info` row with the packet count where no detector fired."""
    found = events(packets, **options)
    seen = found.agg(F.count("*").alias("n"))
    default = (
        packets.agg(F.count("*").alias("amount"))
        .join(seen, F.col("n") == 0)  # one row each
        .select(F.lit("summary").alias("kind"), F.lit("info").alias("severity"), F.lit(None).cast("string").alias("src"), F.lit(None).cast("string").alias("dst"), F.lit(None).cast("int").alias("port"), "amount", F.lit(None).cast("array<int>").alias("sample"), F.lit(3).alias("order_class"), F.lit(0).cast("bigint").alias("order_key"))
    )
    return found.unionByName(default)


def capture_summary(packets: DataFrame, found: DataFrame) -> DataFrame:
    base = packets.agg(F.count("*").alias("packets"), F.count_distinct("src").alias("sources"), F.count_distinct("dst").alias("destinations"))
    return base.join(found.agg(F.count("*").alias("events")), F.lit(True))


def port_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(fixed.SUSPICIOUS_PORTS.items()), "port int, service string")
