import json
import struct
from ipaddress import ip_address

import pytest
from pyspark.sql import functions as F

from sievemill.functions.models import BlockExtractor, ControlGenerator, HashEmbedder, OverlapJudge, TacticLabeller, embedded, extracted_controls, judged, summarized
from sievemill.operators import graph
from sievemill.plans import pipeline, remediation
from sievemill.sources import csvs, folders, jsons, pcap, reports, sinks
from sievemill.streaming import ingest


def write(path, content):
    path.write_bytes(content if isinstance(content, bytes) else content.encode())
    return str(path)


def test_csv_aliases_and_projection(spark, tmp_path):
    path = write(tmp_path / "a.csv", 'Title,Description,Severity,cvss,cve,Host\n"Old TLS","uses CVE-2021-1234",9.8,11,"cve-2021-1234, CVE-2020-0001",web1\n,"only text",warn,abc,,\nx,too,many,fields,are,here,extra\n')
    assert csvs.encoding_of(spark, path) == "UTF-8"
    rows = csvs.read(spark, path)
    got = csvs.findings(rows, "a.csv").orderBy("row_no").collect()
    assert [r.severity for r in got] == ["critical", "medium"]
    assert got[0].title == "Old TLS" and got[0].cvss_score is None and got[0].cve_ids == ["CVE-2020-0001", "CVE-2021-1234", "cve-2021-1234"]
    assert got[0].affected_assets[0].identifier == "web1" and got[1].title.startswith("Entry ") and got[1].description == "only text"
    assert csvs.summary(rows).startswith("CSV with 2 rows")


def test_csv_log_style_and_latin1(spark, tmp_path):
    path = write(tmp_path / "b.csv", "event_time,src_ip,dst_ip,proto,action\n2024-01-02T03:04:05,10.0.0.1,10.0.0.2,TCP,déni\n".encode("latin-1"))
    assert csvs.encoding_of(spark, path) == "ISO-8859-1"
    rows = csvs.read(spark, path, encoding="ISO-8859-1")
    fields = csvs.aliases(rows.columns)
    assert csvs.is_log(fields) and fields["source_ip"] == "src_ip"
    got = csvs.findings(rows).first()
    assert got.title == "From: 10.0.0.1 | To: 10.0.0.2 | Action: déni" and got.description.startswith("event_time: 2024-01-02T03:04:05 | src_ip: 10.0.0.1") and str(got.timestamp_observed) == "2024-01-02 03:04:05"


def frame(src, dst, number, port, size=60):
    tail = struct.pack(">HH", 1234, port) + b"\0" * 16
    ip = bytes([0x45, 0]) + struct.pack(">HHHBBH", 20 + len(tail), 0, 0, 64, number, 0) + ip_address(src).packed + ip_address(dst).packed
    return b"\0" * 12 + b"\x08\x00" + ip + tail, size


def classic(frames, order="<"):
    out = struct.pack(order + "IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1)
    for i, (data, size) in enumerate(frames):
        out += struct.pack(order + "IIII", 1000 + i, 500_000, len(data), size) + data
    return out


def next_generation(frames):
    def block(kind, body):
        body += b"\0" * (-len(body) % 4)
        size = struct.pack("<I", len(body) + 12)
        return struct.pack("<I", kind) + size + body + size

    out = block(0x0A0D0D0A, struct.pack("<IHHq", 0x1A2B3C4D, 1, 0, -1)) + block(1, struct.pack("<HHI", 1, 0, 0))
    for i, (data, size) in enumerate(frames):
        t = (1000 + i) * 1_000_000
        out += block(6, struct.pack("<IIIII", 0, t >> 32, t & 0xFFFFFFFF, len(data), size) + data)
    return out


@pytest.mark.parametrize("make", [classic, lambda f: classic(f, ">"), next_generation])
def test_captures(spark, tmp_path, make):
    frames = [frame("10.0.0.1", "10.0.0.2", 6, 443), frame("10.0.0.1", "10.0.0.2", 17, 53, 600), (b"\0" * 12 + b"\x08\x06" + b"\0" * 28, 42), frame("10.0.0.3", "10.0.0.2", 1, 0)]
    write(tmp_path / "x.pcap", make(frames) + b"\x01\x02")
    pcap.register(spark)
    got = spark.read.format("capture").load(str(tmp_path)).orderBy("seq").collect()
    assert [(r.seq, r.src, r.proto, r.dst_port, r.length) for r in got] == [(0, "10.0.0.1", "TCP", 443, 60), (1, "10.0.0.1", "UDP", 53, 600), (3, "10.0.0.3", "ICMP", None, 60)]
    assert spark.read.format("capture").option("maxPackets", 1).load(str(tmp_path)).count() == 1


REPORT = """Intro
HIGH (CVSS: 7.5)
NVT: Old TLS (OID: 1.3.6.1.4.1.25623.1.0.5)
443/TCP
Host 10.1.2.3 is affected by CVE-2021-1111.
LOW (CVSS: 2.0)
NVT: Banner (OID: 1.3.6.1.4.1.25623.1.0.6)
22/TCP
ssh banner
"""


def test_report_sections(spark):
    docs = spark.createDataFrame([("a", REPORT), ("b", "head\nHigh: something bad\nmore\nlow: minor thing\n"), ("c", "no sections at all"), ("d", None)], "id string, body string")
    got = reports.findings(docs, "id", "body").orderBy("doc_id", "row_no").collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert [(r.title, r.severity, r.cvss_score, r.ports) for r in by["a"]] == [("Old TLS", "high", 7.5, ["443"]), ("Banner", "low", 2.0, ["22"])]
    assert by["a"][0].cve_ids == ["CVE-2021-1111"] and by["a"][0].nvt_oid.endswith(".5") and by["a"][0].affected_assets[0].identifier == "10.1.2.3"
    assert [r.severity for r in by["b"]] == ["high", "low"] and len(by["c"]) == 1 and len(by["d"]) == 1


def test_pages_batches_chunks_blocks(spark, tmp_path):
    write(tmp_path / "ok.pdf", "p0\fp1\fp2")
    write(tmp_path / "bad.pdf", "!")

    def extract(content):
        if content == b"!":
            raise ValueError("broken")
        return content.decode().split("\f")

    rows = reports.pages(spark, str(tmp_path), extract)
    assert {(r.page_no, r.error) for r in rows.collect()} == {(0, None), (1, None), (2, None), (None, "broken")}
    batches = reports.page_batches(rows.withColumnRenamed("path", "pdf_path"), 2).orderBy("batch_index").collect()
    assert [(r.start_page, r.end_page) for r in batches] == [(0, 1), (2, 2)] and batches[0].text == "--- Page 1 ---\np0\n\n--- Page 2 ---\np1"
    df = spark.createDataFrame([("d", "x" * 4500), ("e", None)], "id string, body string")
    assert [[len(c) for c in r[0]] for r in df.select(reports.chunks("body")).collect()] == [[2000, 2000, 500], [0]]
    blocks = spark.createDataFrame([("d", "intro\n1.10 Title one\n" + "b" * 90 + "\n1.1.2 Two\nshort\n2.1 Three\n" + "c" * 90)], "id string, body string")
    assert [(r.number, r.title) for r in reports.benchmark_blocks(blocks, "id", "body").collect()] == [("1.10", "Title one"), ("2.1", "Three")]
    named = spark.createDataFrame([("Rationale: why\nso\nAudit: look\n",)], "x string").select(reports.named_section("x", "Rationale", ["Audit"])).first()[0]
    assert named == "why\nso"


def packet_file(folder, name, ident, summary):
    packet = {"id": ident, "source_file": "s.pdf", "findings": [{"id": f"{ident}-1", "severity": "high", "title": "t", "metadata": {"ports": ["1"], "technical_summary": summary, "mitre_mapping": {"mitre_ids": ["T1059", " "], "validation_passed": True}}}, {"id": f"{ident}-2", "severity": "Critical"}]}
    write(folder / name, json.dumps(packet))


def test_packets_round_trip(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    packet_file(source, "a.json", "p1", "A summary.")
    packet_file(source, "b.json", "p2", None)
    write(source / "broken.json", "{")
    packets = jsons.packets(spark, str(source))
    assert {r.id for r in packets.where("id IS NOT NULL").collect()} == {"p1", "p2"}
    findings = jsons.packet_findings(packets)
    assert findings.count() == 4 and jsons.mapped_findings(packets).count() == 1
    nested = sinks.nested(packets.where("id IS NOT NULL").select(F.col("id").alias("packet_id"), "source_file"), findings.select("packet_id", "row_no", "finding_id", "severity"))
    sinks.write_json(nested, str(tmp_path / "out"), "packet_id")
    back = spark.read.json(str(tmp_path / "out"))
    assert {(r.packet_id, r.finding_count, r.critical_count, r.high_count, len(r.findings)) for r in back.collect()} == {("p1", 2, 1, 1, 2), ("p2", 2, 1, 1, 2)}
    assert sinks.as_json(nested).count() == 2
    files = jsons.inventory(spark, str(source))
    assert files.count() == 3 and jsons.newest(files).first().path is not None and jsons.hashes(spark, str(source)).count() == 3
    assert jsons.file_in(str(source), "a.json").endswith("a.json")
    for name in ("../x.json", "/etc/passwd"):
        with pytest.raises(ValueError):
            jsons.file_in(str(source), name)
    assert jsons.format_of("X.PCAPNG") == "capture"
    with pytest.raises(ValueError):
        jsons.format_of("a.xlsx")


def test_stix_and_oscal(spark, tmp_path):
    pattern = {"type": "attack-pattern", "id": "ap1", "name": "N", "description": "Some  text", "external_references": [{"source_name": "m", "external_id": "T1059.001"}]}
    bundle = {"objects": [pattern, pattern | {"id": "ap2", "revoked": True}, pattern | {"id": "ap3", "x_mitre_deprecated": True}, {"type": "relationship", "relationship_type": "revoked-by", "source_ref": "ap2", "target_ref": "ap1"}]}
    objects = jsons.stix_objects(spark, write(tmp_path / "stix.json", json.dumps(bundle)))
    assert [(r.technique_id, r.technical_summary) for r in jsons.techniques(objects).collect()] == [("T1059.001", "N. Some text")]
    catalog = {"catalog": {"groups": [{"controls": [{"id": "ac-1", "title": "Policy", "parts": [{"prose": "Do {{ x }} it.", "parts": [{"prose": "Then more."}]}], "controls": [{"id": "ac-1.1", "title": "Sub", "parts": [{"prose": "Deep."}]}]}, {"id": "ac-9", "title": "Empty"}]}]}}
    mapping = {"mapping_objects": [{"capability_id": "AC-1", "attack_object_id": "T2", "mapping_type": "mitigates"}, {"capability_id": "ac-01", "attack_object_id": "T1", "mapping_type": "mitigates"}, {"capability_id": None, "attack_object_id": "T3", "mapping_type": "mitigates"}, {"capability_id": "AC-1", "attack_object_id": "T4", "mapping_type": "other"}]}
    nested = graph.nested_controls(jsons.oscal_groups(spark, write(tmp_path / "oscal.json", json.dumps(catalog))))
    assert [r.control_id for r in nested.orderBy("path").collect()] == ["ac-1", "ac-1.1", "ac-9"]
    records = graph.control_records(nested, jsons.attack_mapping(spark, write(tmp_path / "map.json", json.dumps(mapping))))
    got = {r.control_id: r for r in records.collect()}
    assert set(got) == {"NIST-AC-01", "NIST-AC-01.1"} and got["NIST-AC-01"].mitre_ids == ["T1", "T2"]
    assert got["NIST-AC-01"].remediation == "Policy\n\nDo [ASSIGNMENT] it. Then more."
    export = jsons.export_rows(spark, write(tmp_path / "rows.json", json.dumps([{"vendor": "V", "cid": "c", "steps": "s", "mitre_ids": ["T1"]}, {"vendor_name": "W", "control_id": "d"}])))
    assert {(r.vendor_name, r.control_id) for r in export.collect()} == {("V", "c"), ("W", "d")}


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "store")
    sinks.upsert_table(spark, path, spark.createDataFrame([("a", 1, 1)], "k string, v int, at int"), "k", [F.col("at")])
    sinks.upsert_table(spark, path, spark.createDataFrame([("a", 2, 2), ("b", 3, 1)], "k string, v int, at int"), "k", [F.col("at")])
    assert {(r.k, r.v) for r in spark.read.parquet(path).collect()} == {("a", 2), ("b", 3)}
    log = str(tmp_path / "log")
    for i in range(2):
        sinks.append_log(spark.createDataFrame([(f"p{i}", "ok")], "path string, status string"), log)
    assert spark.read.json(log).count() == 2
    sinks.load_collection(spark.createDataFrame([("t2",), ("t1",), ("t1",)], "summary string"), str(tmp_path / "coll"), ["summary"])
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "coll")).collect()) == [1, 2]
    nodes, links = spark.createDataFrame([("a",)], "id string"), spark.createDataFrame([("a", "b")], "source string, target string")
    assert json.loads(sinks.graph_document(nodes, links).first().value) == {"nodes": [{"id": "a"}], "links": [{"source": "a", "target": "b"}]}
    assert sinks.graph_json(nodes, links).count() == 2
    sinks.write_csv(spark.createDataFrame([("b", 1), ("a", 2)], "tag string, n int"), str(tmp_path / "csv"), [F.desc("n")])
    assert [r.tag for r in spark.read.csv(str(tmp_path / "csv"), header=True).collect()] == ["a", "b"]
    assert sinks.output_name("dir/report", "12345678-abc") == "report_12345678.json"


def test_stream_takes_each_file_once(spark, tmp_path):
    source = tmp_path / "new"
    source.mkdir()
    args = dict(source=str(source), schema="k string, v int", target=str(tmp_path / "t"), checkpoint=str(tmp_path / "c"), transform=lambda df: df.withColumn("v", F.col("v") * 2), log=str(tmp_path / "l"))
    write(source / "1.json", '{"k": "a", "v": 1}\n')
    ingest.ingest(spark, **args)
    write(source / "2.json", '{"k": "b", "v": 2}\n')
    ingest.ingest(spark, **args)
    ingest.ingest(spark, **args)
    assert {(r.k, r.v) for r in spark.read.parquet(args["target"]).collect()} == {("a", 2), ("b", 4)}
    assert spark.read.json(args["log"]).count() == 2


def test_models_and_pipeline(spark):
    embedder = HashEmbedder(32)
    got = embedded(spark.createDataFrame([("a b",), (None,)], "t string"), "t", "v", embedder).collect()
    assert abs(sum(x * x for x in got[0].v) - 1) < 1e-5 and not any(got[1].v)

    class Fake:
        def summarize(self, prompts):
            return ["The host exposes an unauthenticated service to attackers." if "good" in p else "junk" for p in prompts]

    rows = spark.createDataFrame([("f1", "Old service", "d", ["CVE-2021-1111"], ["SSH"], "good"), ("f2", "Bad title", "d", None, None, "x")], "finding_id string, title string, description string, cve_ids array<string>, services array<string>, prompt string").withColumn("ingested_at", F.lit("2024-01-01").cast("timestamp_ntz"))
    told = {r.finding_id: r.summary_source for r in summarized(rows, Fake()).collect()}
    assert told == {"f1": "model", "f2": "plain"}
    stages = pipeline.run(
        rows.unionByName(rows),
        spark.createDataFrame([("f1", ["T1190"]), ("f2", ["T4444"])], "finding_id string, mitre_ids array<string>"),
        spark.createDataFrame([("T1190",)], "technique_id string"),
        spark.createDataFrame([(1, "c1", "Patch the SSH service"), (2, "c2", "Lock the door")], "control_no long, control_id string, description string"),
        spark.createDataFrame([("Acme", "c1")], "vendor_name string, control_id string"),
        spark.createDataFrame([("c1", "T1190")], "control_id string, technique_id string"),
        embedder=embedder, allowed=["acme"], summarizer=Fake(),
    )
    ranked = stages.candidates.orderBy("reranked").collect()
    assert [r.control_id for r in ranked] == ["c1", "c2"] and {r.finding_id for r in ranked} == {"f1"}
    assert stages.labelled.where("finding_id = 'f2'").first().accepted == []


def test_pipeline_with_several_mappings_of_a_finding(spark):
    first, second = ["T1190", "T1003", "T1021", "T1046"], ["T1053", "T1110", "T1059", "T1190"]
    late, early = "2024-01-02", "2024-01-01"
    mapped = [(1, "f1", first, late), (1, "f1", ["T1203"], early), (1, "f1", first, late), (2, "f1", second, late), (3, "f2", ["T1190"], late), (None, "f1", ["T1203"], late)]
    known = sorted({*first, *second, "T1203"})
    stages = pipeline.run(
        spark.createDataFrame([("f1", "Old service", "d", None, ["SSH"]), ("f2", "Weak key", "d", None, None)], "finding_id string, title string, description string, cve_ids array<string>, services array<string>").withColumn("ingested_at", F.lit("2024-01-01").cast("timestamp_ntz")),
        spark.createDataFrame(mapped, "mapping_id int, finding_id string, mitre_ids array<string>, mapped_at string").withColumn("mapped_at", F.col("mapped_at").cast("timestamp_ntz")),
        spark.createDataFrame([(t,) for t in known], "technique_id string"),
        spark.createDataFrame([(i, f"c{i}", f"Patch service {i}") for i in range(12)], "control_no long, control_id string, description string"),
        spark.createDataFrame([("Acme", "c1")], "vendor_name string, control_id string"),
        spark.createDataFrame([(f"c{i}", t) for i in range(12) for t in (first[1], second[0])], "control_id string, technique_id string"),
        embedder=HashEmbedder(32), allowed=["acme"], k=6, n=5,
    )
    ranked = stages.candidates.collect()
    for finding in ("f1", "f2"):
        own = [r for r in ranked if r.finding_id == finding]
        assert len(own) == len({r.control_id for r in own}) == 5 and sorted(r["rank"] for r in own) == [1, 2, 3, 4, 5]
    assert all(set(r.mitre_ids) == {*first, *second} and len(r.mitre_ids) == 7 for r in ranked if r.finding_id == "f1")
    assert all(r.matched_mitre == sorted([first[1], second[0]]) for r in ranked if r.finding_id == "f1")
    assert sorted((r.finding_id, r.mapping_id) for r in stages.labelled.collect()) == [("f1", 1), ("f1", 2), ("f2", 3)]


def test_long_capture_is_read_whole(tmp_path):
    packet = b"\x00" * 12 + b"\x08\x00" + bytes([0x45, 0, 0, 28, 0, 0, 0, 0, 64, 17, 0, 0, 10, 0, 0, 1, 10, 0, 0, 2]) + bytes([0, 9, 0, 53, 0, 8, 0, 0])
    record = struct.pack("<IIII", 1, 0, len(packet), len(packet)) + packet
    path = write(tmp_path / "long.pcap", struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1) + record * 10_050)
    reader = pcap._Reader({"path": path})
    assert sum(1 for _ in reader.read(reader.partitions()[0])) == 10_050


def mixed_folder(tmp_path):
    where = tmp_path / "in"
    (where / "deep").mkdir(parents=True)
    write(where / "a.csv", "title,description,severity,cve\nOpen telnet service,Anyone can log in remotely with default credentials on the public-facing host,high,CVE-2031-1111\nWeak cipher,Old ssl,low,\n")
    write(where / "b.csv", "title,description,severity,cve\nThird finding,text,info,\n")
    write(where / "empty.csv", " \n")
    write(where / "c.pdf", b"HIGH (CVSS: 7.5)\nNVT: Leaky mail relay (OID: 1.3.6.1.4.1.25623.1.7)\n25/TCP\nAnyone relays mail.\n")
    write(where / "bad.pdf", b"\xff\xfe")
    write(where / "d.pcap", classic([frame("10.0.0.1", "10.0.0.2", 6, 3389)]))
    write(where / "broken.pcap", b"nothing")
    write(where / "e.json", json.dumps({"id": "p1", "findings": [{"id": "x", "title": "Packet finding", "severity": "low", "description": "d"}]}))
    write(where / "deep" / "f.csv", "name,info\nDeep one,body\n")
    write(where / "notes.txt", "left out")
    return str(where)


def test_folder_of_all_formats(spark, tmp_path):
    where = mixed_folder(tmp_path)
    got = folders.ingest(spark, where, extract=lambda b: b.decode("utf-8").split("\f"))
    rows = got.findings.collect()
    titles = {r.title for r in rows}
    assert {"Open telnet service", "Weak cipher", "Third finding", "Leaky mail relay", "Packet finding"} <= titles and "Deep one" not in titles
    assert any("suspicious port" in t for t in titles) and len({r.finding_id for r in rows}) == len(rows) == 6
    assert {(r.path.rsplit("/", 1)[1], r.row_no) for r in rows if r.path.endswith(".csv")} == {("a.csv", 0), ("a.csv", 1), ("b.csv", 0)}
    assert {r.path.rsplit("/", 1)[1] for r in got.errors.collect()} == {"empty.csv", "bad.pdf", "broken.pcap"}
    again = folders.ingest(spark, where, recursive=True)
    assert "Deep one" in {r.title for r in again.findings.collect()}
    assert {r.path.rsplit("/", 1)[1] for r in again.errors.collect()} == {"empty.csv", "bad.pdf", "c.pdf", "broken.pcap"}


def test_from_a_folder_to_remediation(spark, tmp_path):
    class Forgetful(ControlGenerator):
        """Leaves the substeps out until it is told."""

        def generate(self, prompts, issues):
            made = [json.loads(x) for x in ControlGenerator().generate(prompts, issues)]
            for out, wrong in zip(made, issues, strict=True):
                for s in out["steps"] if not wrong else []:
                    s["substeps"] = []
            return [json.dumps(x) for x in made]

    read, stages = pipeline.run_folder(
        spark, mixed_folder(tmp_path), TacticLabeller(),
        spark.createDataFrame([("T1566",), ("T1110",), ("T1021",)], "technique_id string"),
        spark.createDataFrame([(1, "c1", "Disable the telnet service and default credentials"), (2, "c2", "Lock the door")], "control_no long, control_id string, description string"),
        spark.createDataFrame([("Acme", "c1")], "vendor_name string, control_id string"),
        spark.createDataFrame([("c1", "T1566")], "control_id string, technique_id string"),
        extract=lambda b: b.decode("utf-8").split("\f"), embedder=HashEmbedder(32), allowed=["acme"], generator=Forgetful(), judge=OverlapJudge(),
    )
    rows = {r.technical_summary: r for r in stages.remediated.collect()}
    assert read.errors.count() == 3 and any(s.startswith("Open telnet service") for s in rows)
    told = next(r for s, r in rows.items() if s.startswith("Open telnet service"))
    assert told.attempts > 1 and told.output.source_control_ids[0] == "c1" and told.substep_quality == 1.0
    assert len(told.output.steps[0].substeps) == 3  # the second attempt knew what was missing
    meta = remediation.metadata(stages.remediated, model="m", prompt_version="1").where(F.col("finding_id") == told.finding_id).first().remediation
    assert meta.selfrag_verification.attempts == told.attempts and meta.provenance.mode == "graph_only" and meta.source_control_ids == told.output.source_control_ids
    state = remediation.remember(spark.createDataFrame([("old", 3)], "finding_id string, version int"), stages.remediated)
    assert {r.version for r in state.collect()} <= {3, 4} and state.where("finding_id = 'old'").count() == 1


def test_remediable_and_names(spark):
    schema = "finding_id string, technical_summary string, severity string, mitre_ids array<string>, best " + remediation.CONTROL + f", vendor_controls array<{remediation.CONTROL}>, framework_controls array<{remediation.CONTROL}>, similarity double, score double, vendor_matched boolean"
    best = ("c", "V", "do it", None)
    rows = spark.createDataFrame([("a", "text", None, ["T1"], best, None, None, 0.1, 0.2, True), ("b", " ", None, None, best, None, None, 0.1, 0.2, True), ("c", "text", None, None, None, None, None, None, None, None)], schema)
    assert [r.finding_id for r in remediation.remediable(rows).collect()] == ["a"]
    made = remediation.remediate(rows, ControlGenerator(), retries=0).collect()
    assert [(r.finding_id, r.attempts) for r in made] == [("a", 1)]
    assert remediation.file_name("x_correlated", "20310101_000000") == "x_remediated_20310101_000000.json"


def test_generator_that_answers_nonsense(spark):
    class Bad:
        def generate(self, prompts, issues):
            return ["{not json" for _ in prompts]

    schema = "finding_id string, technical_summary string, severity string, mitre_ids array<string>, best " + remediation.CONTROL + f", vendor_controls array<{remediation.CONTROL}>, framework_controls array<{remediation.CONTROL}>"
    rows = spark.createDataFrame([("a", "text", "low", ["T1"], ("c", None, None, None), None, None)], schema)
    r = remediation.remediate(rows, Bad(), retries=1).first()
    assert not r.passed and r.attempts == 2 and r.grounding == 0.0 and "[grounding/error] no steps" in r.issues


def test_extractor_and_judge(spark):
    df = spark.createDataFrame([(1, "Intro\n1.1 Set the mode\nUse T1059 care.\n1.2 Other\nBody"), (2, None), (3, "nothing")], "k int, text string")
    got = extracted_controls(df, BlockExtractor()).orderBy("control_id").collect()
    assert [(r.k, r.control_id, r.title, r.mitre_ids) for r in got] == [(1, "1.1", "Set the mode", ["T1059"]), (1, "1.2", "Other", [])]
    rows = spark.createDataFrame([(["disable telnet service", "unrelated things"], "Disable the telnet service."), ([], "x"), (None, None)], "s array<string>, source string")
    assert [r.verdicts for r in judged(rows, OverlapJudge(), F.col("s"), "source").collect()] == [["SUPPORTED", "NOT_SUPPORTED"], [], []]


def test_summaries_come_from_the_cache_first(spark):
    class Counting:
        def summarize(self, prompts):
            assert None not in prompts
            return ["The host exposes an unauthenticated service to attackers." for _ in prompts]

    rows = spark.createDataFrame([("f1", "Old", None, None, "p1"), ("f2", "New", None, None, "p2")], "finding_id string, title string, cve_ids array<string>, services array<string>, prompt string").coalesce(1)
    first = {r.finding_id: r.cache_key for r in summarized(rows, Counting()).collect()}
    cache = spark.createDataFrame([(first["f1"], "The cached sentence speaks of weak keys.")], "key string, summary string")
    got = {r.finding_id: (r.technical_summary, r.summary_source) for r in summarized(rows, Counting(), cache=cache).collect()}
    assert got["f1"] == ("The cached sentence speaks of weak keys.", "cache") and got["f2"][1] == "model"


def test_label_corpus_names_and_checked_store(spark, tmp_path):
    from sievemill.operators import remap

    moved = remap.map_column(spark.createDataFrame([("T9000", "T1190")], "old string, new string"))
    write(tmp_path / "c.jsonl", '{"text": "Summary:  Weak  key", "mitre_tags": ["t9000", "T1059.001"]}\n{"text1": "Old", "labels": ["T1059"]}\n{"text": " ", "labels": ["T1059"]}\n{"text": "No tag", "labels": ["X1"]}\n')
    got = jsons.label_corpus(spark, str(tmp_path / "c.jsonl"), moved, ["T1190", "T1059"]).collect()
    assert sorted((r.text1_norm, tuple(r.tags_norm)) for r in got) == [("Old", ("T1059",)), ("Weak key", ("T1059.001", "T1190"))]
    for name in ("b_correlated.json", "a_correlated.json", "other.json"):
        write(tmp_path / name, "{}")
    assert [r.path.rsplit("/", 1)[1] for r in jsons.correlated_files(spark, str(tmp_path)).collect()] == ["a_correlated.json", "b_correlated.json"]
    assert sinks.stage_name("x/p_correlated", "remediated", "S") == "p_remediated_S.json" and sinks.stage_name("p", "mapped", "S") == "p_mapped_S.json"
    rows = spark.createDataFrame([("a", 1), ("b", 1)], "k string, v int")
    sinks.write_checked(rows, str(tmp_path / "ok"), ["k"])
    with pytest.raises(ValueError, match="v is not unique"):
        sinks.write_checked(rows, str(tmp_path / "no"), ["k", "v"])
    ids = F.array(F.lit("T1059.001"), F.lit("T1190"))
    one = spark.range(1).select(remap.normal_tags(ids, moved, ["T1190", "T1059"], by_root=False, ordered=False)).first()[0]
    assert one == ["T1190"]


def test_benchmark_styles_and_cleaning(spark):
    rule = "1.10 WN11-00-000040 (Manual)\nDescription: {0}\nRationale: short\nRemediation: {0}\nPage 7\n"
    body = "x" * 45 + " end"
    docs = spark.createDataFrame([("a", "".join(rule.format(body) for _ in range(3)) + "1.1.1 (L1) Ensure it " + "y" * 60), ("b", rule.format(body) + "1.1.1 (L1) Ensure it\nok\n" + "y" * 60 + "\n1.1.2 short"), ("c", None)], "k string, t string")
    got = {}
    for r in reports.benchmark_controls(docs, "k", "t").orderBy("doc_id", "place").collect():
        got.setdefault(r.doc_id, []).append((r.label, r.description))
    assert [x[0] for x in got["a"]] == ["1.10-WN11-00-000040"] * 3 and [x[0] for x in got["b"]] == ["1.10-WN11-00-000040", "1.1.1"]
    assert got["b"][1][1] == "(L1) Ensure it " + "y" * 60 and "Page" not in got["b"][0][1] and "c" not in got
    texts = spark.createDataFrame([("Copyright by us\nReal text Page 12 ....... 9", "[Assignment: x] Do .... it\n... 12")], "a string, b string")
    assert tuple(texts.select(reports.cleaned("a"), reports.display_clean("b")).first()) == ("Real text", "Do it")
    graph_rows = reports.demo_graph(spark.createDataFrame([("F", "1.1", "Encrypt the disk")], "f string, label string, description string"), "f")
    assert graph_rows.first().mitre_ids == ["T1486", "T1190"]
    pages = spark.createDataFrame([("a", 1, "two"), ("a", 0, "one"), ("a", 1, "two"), (None, 1, "x"), ("a", None, "x"), ("b", 3, None)], "pdf_path string, page_no int, page_text string")
    assert {r.pdf_path: r.body for r in reports.whole_documents(pages).collect()} == {"a": "one\ntwo", "b": ""}


def test_page_batches_are_taken_once_and_fail_alone(spark, tmp_path):
    class Picky(BlockExtractor):
        def extract(self, texts):
            if any("poison" in t for t in texts):
                raise RuntimeError("cannot read this")
            return BlockExtractor().extract(texts)

    rows = [("a", i, f"1.{i} Control {i}\nSet T1059.") for i in range(7)] + [("b", 0, "poison"), ("b", 5, "2.1 Fine\nbody")]
    pages = spark.createDataFrame(rows, "pdf_path string, page_no int, page_text string")
    target, log = str(tmp_path / "controls"), str(tmp_path / "log")
    assert ingest.ingest_batches(pages, Picky(), target, log, max_batches=1) == 1
    assert ingest.ingest_batches(pages, Picky(), target, log) == 3
    assert spark.read.parquet(target).count() == 8
    told = spark.read.json(log)
    assert {(r.pdf_path, r.batch_index, r.status) for r in told.collect()} == {("a", 0, "ok"), ("a", 1, "ok"), ("b", 0, "error"), ("b", 1, "ok")}
    assert ingest.ingest_batches(pages, BlockExtractor(), target, log) == 1  # only the failed one


def test_controls_are_upserted_once(spark, tmp_path):
    schema = "key string, control_id string, remediation string, mitre_ids array<string>"
    rows = spark.createDataFrame([("AC-01", "NIST-AC-01", "Do it", ["T1"]), ("AC-02", "NIST-AC-02", " ", None)], schema)
    target, log = str(tmp_path / "t"), str(tmp_path / "l")
    assert {(r.join_key, r.status) for r in ingest.ingest_controls(rows, target, log, "nist").collect()} == {("AC-01", "ok"), ("AC-02", "skipped")}
    assert ingest.ingest_controls(rows, target, log, "nist").count() == 0
    assert [(r.key, r.mitre_ids) for r in spark.read.parquet(target).collect()] == [("AC-01", ["T1"])]
