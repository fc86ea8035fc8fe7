import json

import pytest
from pyspark.sql import functions as F

from sievemill.functions import fixed, render

ASSET = "array<struct<identifier:string,asset_type:string,details:string>>"
CONTROL = "struct<control_id:string,vendor_product:string,remediation_steps:string,audit_procedure:string>"


def test_packet_context(spark):
    finding = ("T", "high", "d" * 600, ["CVE-1"], [(f"h{i}", None, None) for i in range(7)])
    df = spark.createDataFrame([([finding, (None, None, None, None, None)], "a.pdf", "pdf")], f"f array<struct<title:string,severity:string,description:string,cve_ids:array<string>,affected_assets:{ASSET}>>, s string, k string")
    got = df.select(render.packet_context("f", "s", "k")).first()[0]
    assert got.startswith("Source: a.pdf (pdf)\nFindings: 2 total (0 critical, 1 high)\n\n--- Findings ---\n\n[1] T (HIGH)\n    " + "d" * 500 + "...\n    CVEs: CVE-1\n    Affected: h0, h1, h2, h3, h4")
    assert got.endswith("[2]  (UNKNOWN)\n    ...")


def test_examples_and_query(spark):
    df = spark.createDataFrame([([("s", ["T1"], 0.12345)], "sum", ["T1", "T2"], [])], "p array<struct<technical_summary:string,mitre_ids:array<string>,similarity:double>>, s string, ids array<string>, none array<string>")
    got = df.select(render.examples("p"), render.query_text("s", "ids"), render.query_text("s", "none")).first()
    assert tuple(got) == ("Example 1 (similarity 0.123)\nSummary: s\nTechniques: ['T1']", "Security control to remediate: sum MITRE ATT&CK techniques: T1, T2.", "Security control to remediate: sum")


def test_controls_once_in_order(spark):
    df = spark.createDataFrame([(("a", "V", None, "x"), [("a", "W", None, None), ("b", None, "r", None)], None)], f"best {CONTROL}, v array<{CONTROL}>, f array<{CONTROL}>")
    got = df.select(render.controls_text("best", "v", "f")).first()[0]
    assert got == "[BEST MATCH] Control: a\n  Vendor/Product: V\n  Remediation: N/A\n  Audit: x\n\nControl: b\n  Vendor/Product: N/A\n  Remediation: r\n  Audit: N/A"


def test_search_reason(spark):
    rows = [(True, 0.1, 0.1, True), (False, 0.9, 0.9, True), (False, 0.4, 0.9, False), (None, 0.9, 0.4, False), (False, None, None, None), (False, 0.42, 0.48, False)]
    df = spark.createDataFrame(rows, "v boolean, s double, c double, h boolean")
    got = [r[0] for r in df.select(render.search_reason(*(F.col(x) for x in "vsch"))).collect()]
    assert got == [None, "vendor hint", "low similarity", "low composite", None, None]


def test_small_ones(spark):
    df = spark.createDataFrame([(["a ", " ", "b" * 600], '{"webSearchQueries": ["aB: x"], "plain": {"startIndex": 1}}', "Acme WIDGET", "remote code here")], "s array<string>, j string, t string, b string")
    families = [(["remote"], ["T1", "T2"]), (["code"], ["T2", "T3", "T4"]), (["none"], ["T9"])]
    got = df.select(render.grounding_excerpt("s"), render.snake_keys("j"), render.hinted(["widget"], F.col("t")), render.hinted([], F.col("t")), render.by_keywords("b", families, ["T7", "T8"]), render.by_keywords("t", families, ["T7", "T8"])).first()
    assert got[0] == "- a\n- " + "b" * 500
    assert json.loads(got[1]) == {"web_search_queries": ["aB: x"], "plain": {"start_index": 1}}
    assert got[2] and not got[3] and got[4] == ["T1", "T2", "T3"] and got[5] == ["T7", "T8"]
    assert render.identifier("idx_1") == "idx_1"
    with pytest.raises(ValueError):
        render.identifier("x; drop")


def test_retrying():
    waits, calls = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise OSError("limit" if len(calls) == 2 else "busy")
        return "done"

    assert render.retrying(flaky, sleep=waits.append, limited=lambda e: "limit" in str(e)) == "done"
    assert len(waits) == 2 and waits[1] >= 30
    with pytest.raises(ValueError):
        render.retrying(lambda: (_ for _ in ()).throw(ValueError()), transient=lambda e: isinstance(e, OSError), sleep=waits.append)


def test_context_texts(spark):
    rows = [("partner", "Own words", ["T1"], "Their words", None), ("partner", "Same", ["T1"], "Same", None), ("partner", "Own", ["T1"], None, None), ("contradictory", "Own words", ["T1"], None, ["T2"]), ("contradictory", None, ["T1"], None, []), ("self", "Own\nwords", ["T1"], None, None), ("none", "Own", ["T1"], "x", None)]
    df = spark.createDataFrame(rows, "kind string, s string, ids array<string>, p string, w array<string>")
    got = [r[0] for r in df.select(render.context_text(F.col("kind"), "s", "ids", "p", "w")).collect()]
    form = "1. Summary: {0}\n   Verified MITRE IDs: ['{1}'] (similarity=0.850)"
    none = fixed.NO_EXAMPLES
    assert got == [form.format("Their words...", "T1"), none, none, form.format("Own words [contradictory RAG]", "T2"), none, form.format("Own words...", "T1"), none]


def test_errors_of_a_model_service():
    class Coded(Exception):
        def __init__(self, code, said=""):
            super().__init__(said)
            self.code = code

    assert render.is_transient(Coded(503)) and not render.is_transient(Coded(401)) and render.is_limited(Coded(429)) and not render.is_limited(Coded(503))
    assert render.is_transient(Exception("model is overloaded, try again")) and not render.is_transient(Exception("400 try again")) and not render.is_transient(Exception("odd"))
    assert render.is_limited(Exception("Too many requests")) and not render.is_limited(Exception("503 unavailable"))
    tried = []

    def busy():
        tried.append("busy")
        raise Coded(503)

    assert render.with_fallback([busy, lambda: "second"], attempts=2, sleep=lambda s: None) == "second" and tried == ["busy", "busy"]
    with pytest.raises(Coded):
        render.with_fallback([lambda: (_ for _ in ()).throw(Coded(401)), lambda: "never"], attempts=2, sleep=lambda s: None)
