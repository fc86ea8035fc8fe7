"""Packet captures as a Python data source: classic pcap and pcapng, Ethernet, raw IP and loopback, IPv4 and IPv6.

A capture has no index, so one file is one partition; many files are many partitions. A file is read as a stream.
Register with `register(spark)`, then `spark.read.format("capture").load(path)`.
"""

from __future__ import annotations

import fnmatch
import struct
from collections.abc import Iterator
from ipaddress import ip_address
from typing import BinaryIO
from urllib.parse import unquote

from pyarrow import fs as stores
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, seq bigint, ts double, src string, dst string, proto string, dst_port int, length int"
MAX_PACKETS = 0
PROTOCOLS = {1: "ICMP", 6: "TCP", 17: "UDP", 58: "ICMP"}


def frames(f: BinaryIO) -> Iterator[tuple[float, int, int, bytes]]:
    """time, link type, wire length and bytes of every packet; stops quietly at a cut end."""
    magic = f.read(4)
    if magic == b"\x0a\x0d\x0d\x0a":
        yield from _next_generation(f)
        return
    order, scale = {b"\xd4\xc3\xb2\xa1": ("<", 1e6), b"\xa1\xb2\xc3\xd4": (">", 1e6), b"\x4d\x3c\xb2\xa1": ("<", 1e9), b"\xa1\xb2\x3c\x4d": (">", 1e9)}.get(magic, ("", 0))
    head = f.read(20)
    if not order or len(head) < 20:
        raise ValueError("no packet capture")
    link = struct.unpack(order + "I", head[16:20])[0] & 0xFFFF
    while len(record := f.read(16)) == 16:
        seconds, part, kept, size = struct.unpack(order + "IIII", record)
        data = f.read(kept)
        if len(data) < kept:
            return
        yield seconds + part / scale, link, size, data


def _next_generation(f: BinaryIO) -> Iterator[tuple[float, int, int, bytes]]:
    order, links, units = "<", [], []
    kind = 0x0A0D0D0A
    while True:
        raw = f.read(4)
        if len(raw) < 4:
            return
        if kind == 0x0A0D0D0A:
            mark = f.read(4)
            order = "<" if mark == b"\x4d\x3c\x2b\x1a" else ">"
            links, units = [], []
            size = struct.unpack(order + "I", raw)[0]
            f.read(size - 12)
        else:
            size = struct.unpack(order + "I", raw)[0]
            body = f.read(size - 8)
            if len(body) < size - 8:
                return
            if kind == 1:
                links.append(struct.unpack(order + "H", body[:2])[0])
                units.append(_unit(body[8:-4], order))
            elif kind == 6 and len(body) >= 20:
                at, high, low, kept, wire = struct.unpack(order + "IIIII", body[:20])
                if at < len(links):
                    yield (high << 32 | low) * units[at], links[at], wire, body[20 : 20 + kept]
        head = f.read(4)
        if len(head) < 4:
            return
        kind = struct.unpack(order + "I", head)[0]


def _unit(options: bytes, order: str) -> float:
    at = 0
    while at + 4 <= len(options):
        code, size = struct.unpack(order + "HH", options[at : at + 4])
        if code == 0:
            break
        if code == 9 and size:
            v = options[at + 4]
            return 2.0 ** -(v & 127) if v & 128 else 10.0**-v
        at += 4 + (size + 3 & ~3)
    return 1e-6


def parsed(link: int, data: bytes) -> tuple[str, str, str, int | None] | None:
    """src, dst, protocol and destination port of an IP packet; None for anything else."""
    if link == 1:
        kind, at = int.from_bytes(data[12:14], "big"), 14
        while kind in (0x8100, 0x88A8) and len(data) >= at + 4:
            kind, at = int.from_bytes(data[at + 2 : at + 4], "big"), at + 4
        if kind not in (0x0800, 0x86DD):
            return None
        body = data[at:]
    elif link == 0:
        body = data[4:]
    elif link == 113:
        body = data[16:]
    elif link in (12, 14, 101, 228, 229):
        body = data
    else:
        return None
    version = body[0] >> 4 if body else 0
    if version == 4 and len(body) >= 20:
        number, src, dst, rest = body[9], body[12:16], body[16:20], body[(body[0] & 15) * 4 :]
        if int.from_bytes(body[6:8], "big") & 0x1FFF:
            rest = b""  # a later fragment has no ports
    elif version == 6 and len(body) >= 40:
        number, src, dst, rest = body[6], body[8:24], body[24:40], body[40:]
    else:
        return None
    protocol = PROTOCOLS.get(number, "Other")
    port = int.from_bytes(rest[2:4], "big") if protocol in ("TCP", "UDP") and len(rest) >= 4 else None
    return str(ip_address(src)), str(ip_address(dst)), protocol, port


def _store(where: str) -> tuple[stores.FileSystem, str]:
    """The file system of a path or address (local, hdfs://, s3://, ...) and the path in it."""
    return stores.FileSystem.from_uri(where) if "://" in where else (stores.LocalFileSystem(), where)


def store_of(path: str) -> tuple[stores.FileSystem, str]:
    """The same for a path as Spark lists it (`file:/a`, `hdfs://...`)."""
    return (stores.LocalFileSystem(), "/" + unquote(path[5:]).lstrip("/")) if path.startswith("file:") else _store(path)


def captures(where: str) -> list[str]:
    """Capture files below a folder, those that match a pattern, or the one file, sorted; in the form they were asked for."""
    head = where[: where.index("://") + 3] if "://" in where else ""
    store, path = _store(where)
    rest = where[len(head) :]
    lead = rest[: len(rest) - len(path)] if rest.endswith(path) else ""
    found = store.get_file_info(path)
    if found.type == stores.FileType.File:
        return [where]
    if found.type == stores.FileType.Directory:
        inside = [i.path for i in store.get_file_info(stores.FileSelector(path, recursive=True)) if i.type == stores.FileType.File]
        names = [p for p in inside if fnmatch.fnmatch(p.rsplit("/", 1)[-1], "*.pcap*")]
    else:
        folder = path.rsplit("/", 1)[0] or "/"
        inside = store.get_file_info(stores.FileSelector(folder, allow_not_found=True))
        names = [i.path for i in inside if i.type == stores.FileType.File and fnmatch.fnmatch(i.path, path)]
    return sorted(f"{head}{lead}{p}" for p in names)


class _File(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.most = int(options.get("maxPackets", MAX_PACKETS))
        self.paths = captures(options.get("path", ""))

    def partitions(self):
        return [_File(p) for p in self.paths]

    def read(self, partition):
        if partition is None:
            return
        store, path = _store(partition.path)
        with store.open_input_stream(path, buffer_size=1 << 20) as f:
            for seq, (ts, link, size, data) in enumerate(frames(f)):
                if self.most and seq >= self.most:
                    return
                if got := parsed(link, data):
                    src, dst, protocol, port = got
                    yield partition.path, seq, ts, src, dst, protocol, port, size


class CaptureSource(DataSource):
    """Options: path (file, pattern or folder, also of a cluster store), maxPackets (0, the default, for all; the plain parser stops at 10,000)."""

    @classmethod
    def name(cls) -> str:
        return "capture"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(CaptureSource)
