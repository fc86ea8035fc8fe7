import re

import pytest
from pyspark.sql import functions as F

from sievemill.functions import fixed, text


def one(spark, expression, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expression(F.col("x"))).first()[0]


@pytest.mark.parametrize(("value", "want"), [("9.8", "critical"), ("7", "high"), ("4.0", "medium"), ("0.1", "low"), ("0", "info"), ("Critical", "critical"), ("warn", "medium"), ("notice", "low"), ("debug", "info"), (" ", "unknown"), (None, "unknown"), ("NaN", "unknown"), ("-1", "info")])
def test_severity(spark, value, want):
    assert one(spark, text.severity_of, value) == want


def test_severity_in_text_matches_inside_words(spark):
    assert one(spark, text.severity_in_text, "please follow the guide") == "low"
    assert one(spark, text.severity_in_text, "HIGH risk") == "high"
    assert one(spark, text.severity_in_text, None) == "unknown"


@pytest.mark.parametrize(("value", "want"), [("CVSS: 7.5", 7.5), ("(CVSS: 10.0)", 10.0), ("cvss 9", 9.0), ("CVSS: 11", None), ("xCVSS: 5.0", None), (None, None)])
def test_cvss(spark, value, want):
    assert one(spark, text.cvss_in_text, value) == want


def test_extractors(spark):
    body = "NVT: Old TLS (OID: 1.3.6.1.4.1.25623.1.0.99) on 10.0.0.5, 1.3.6.1 and 10.0.0.5; 443/TCP 0/TCP 70000/udp 53/UDP https HOST-1.corp.local CVE-2021-1234 cve-2021-1234 CVE-2021-1234"
    got = spark.createDataFrame([(body,)], "x string").select(text.oid("x"), text.nvt_title("x"), text.ips("x"), text.ports("x"), text.services("x"), text.hostnames("x"), text.cves("x")).first()
    assert tuple(got) == ("1.3.6.1.4.1.25623.1.0.99", "Old TLS", ["10.0.0.5"], ["443", "53"], ["HTTP", "HTTPS"], ["host-1.corp.local"], ["CVE-2021-1234", "cve-2021-1234"])
    none = spark.createDataFrame([(None,)], "x string").select(text.ips("x"), text.ports("x"), text.services("x"), text.cves("x")).first()
    assert tuple(none) == ([], [], [], [])


@pytest.mark.parametrize(("value", "want"), [("2024-01-02T03:04:05", "2024-01-02 03:04:05"), ("2024-01-02 03:04:05", "2024-01-02 03:04:05"), ("2024-01-02", "2024-01-02 00:00:00"), ("never", None), (None, None)])
def test_timestamp(spark, value, want):
    got = one(spark, text.timestamp_of, value)
    assert (str(got) if got else None) == want


@pytest.mark.parametrize(("value", "want"), [("The host runs an outdated SSH server with CVE-2021-1234.", True), ("Too short.", False), ("no full stop at the end here", False), ("This has multiple vulnerabilities in the server code.", False), ("One thing here. Two things here. Three things here.", False), ("It uses v9.3p2 and e.g. old keys on the host.", True), (None, False), (" ".join(["w"] * 90) + ".", False)])
def test_valid_summary(spark, value, want):
    assert bool(one(spark, text.valid_summary, value)) is want


def test_plain_summary(spark):
    rows = [("Old TLS (CVSS: 5.0)", ["CVE-1"], ["HTTPS"]), ("Old TLS", ["CVE-1"], []), ("Old TLS", [], ["SSH"]), ("Old TLS", None, None), (None, None, None)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string, c array<string>, s array<string>").select(text.plain_summary("t", "c", "s")).collect()]
    assert got == ["Old TLS affects the HTTPS service and is associated with CVE-1.", "Old TLS is associated with CVE-1.", "Old TLS affects the SSH service.", "Old TLS affects the target system.", "The finding indicates a security-relevant condition on the target system."]


def test_document_summary(spark):
    long = "This assessment covers the plant network and lists what has to be done first by whom."
    assert one(spark, text.document_summary, f"Title\nExecutive Summary:\n{long}\n\nrest") == long
    assert one(spark, text.document_summary, "short\n\n" + "p" * 1200) == "p" * 1000
    assert one(spark, text.document_summary, "nothing here") is None


@pytest.mark.parametrize(("value", "want"), [("ac-1", "AC-01"), ("AC-1", "AC-01"), ("ac-12", "AC-12"), ("ac-2.1", "AC-02.1"), ("AC-123", "AC-123"), ("odd id", "ODDID"), (None, "")])
def test_control_key(spark, value, want):
    assert one(spark, text.control_key, value) == want


def test_ids_and_literals(spark):
    assert one(spark, text.technique_ids, "['t1059', 'T1059', 'T1190.001'] and T1003") == ["T1059", "T1190.001"]
    assert one(spark, text.normal_ids, [" t1059 ", "T1059", None, "x", "T1.1"], "array<string>") == ["T1059"]
    assert one(spark, text.list_literal, ["T1", "T2"], "array<string>") == "['T1', 'T2']"
    assert one(spark, text.parse_literal, "['T1057', 'T1']") == ["T1057", "T1"]
    assert one(spark, text.parse_literal, "oops") == []


def test_tokens_match_python(spark):
    value = "The Server runs an OLD tls stack on port 443, and the stack is old"
    want = {w for w in re.findall("[a-z0-9]+", value.lower()) if len(w) > 2 and w not in fixed.STOPWORDS}
    got = one(spark, text.tokens, value)
    assert set(got) == want and len(got) == len(want)


def test_shaping(spark):
    assert one(spark, lambda x: text.truncate(x, 5), "abcdefgh") == "abcd…"
    assert one(spark, text.slug, "My  Vendor/Name!") == "fw-my-vendor-name"
    assert one(spark, text.without_placeholders, "keep {{ insert: x }} it") == "keep [ASSIGNMENT] it"
    assert one(spark, text.training_text, "Summary: a\n b") == "a b"
    assert one(spark, text.step_numbers, ["Step 3 and step 12", "Step 3"], "array<string>") == ["3", "12"]
    assert one(spark, lambda x: text.cache_key(b=x, a=F.lit(1)), "v") == one(spark, lambda x: text.cache_key(a=F.lit(1), b=x), "v")
    assert one(spark, text.split_list, "a, b,, c ") == ["a", "b", "c"]
    assert one(spark, text.collapse, " a \t b ") == "a b"
