import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievemill.functions import fixed, text
from sievemill.operators import correlate, dedup, detect, gates, graph, labels, metrics, remap, state, stats, vectors, verify
from sievemill.operators.common import latest

PACKET = "seq bigint, ts double, src string, dst string, proto string, dst_port int, length int"


def packets(spark, rows):
    return spark.createDataFrame(rows, PACKET)


def test_detector_limits(spark):
    rows = [(i, 0.0, "a", "b", "TCP", i, 60) for i in range(19)] + [(100 + i, 0.0, "c", "d", "UDP", i, 60) for i in range(20)]
    rows += [(200 + i, 0.0, "e", "f", "TCP", 80, 60) for i in range(99)] + [(300 + i, 0.0, "f", "e", "ICMP", None, 60) for i in range(100)]
    rows += [(500, 0.0, "g", "h", "TCP", 3389, 60), (501, 0.0, "g", "h", "TCP", 3389, 60), (502, 0.0, "g", "h", "UDP", 3389, 60), (503, 0.0, "g", "h", "UDP", 53, 512), (504, 0.0, "g", "h", "UDP", 53, 513)]
    got = [tuple(r)[:7] for r in detect.events(packets(spark, rows)).orderBy("order_class", "order_key").collect()]
    assert [(k, src) for k, _, src, *_ in got] == [("suspicious_port", "g"), ("suspicious_port", "g"), ("large_dns_query", "g"), ("port_scan", "c"), ("connection_flood", "f")]
    assert got[3][6] == list(range(10))


def test_summary_row_when_nothing_fires(spark):
    quiet = packets(spark, [(0, 0.0, "a", "b", "ICMP", None, 60)])
    assert [(r.kind, r.amount) for r in detect.events_or_summary(quiet).collect()] == [("summary", 1)]
    assert [(r.kind, r.amount) for r in detect.events_or_summary(packets(spark, [])).collect()] == [("summary", 0)]


def registry():
    return ["T1102", "T1190", "T1059", "T1003", "T1021", "T1046", "T1053", "T1110"]


@pytest.mark.parametrize(
    ("ids", "summary", "accepted", "passed"),
    [
        (["T1102"], "An end-of-life web server is exposed.", ["T1190"], True),
        (["T1102.002"], "A public-facing page is served.", ["T1190"], True),
        (["T1102"], "A neutral sentence about a printer.", [], True),
        (["T1102"], "The beacon uses a dead drop.", ["T1102"], True),
        ([], "anything", [], True),
        (None, None, [], True),
        (["T1102", "T1190"], "An end-of-life web server.", ["T1190"], True),
        (["t1190 ", "T1190", "T9999"], "exploit", ["T1190"], False),
        (["T1190", "T1059", "T1003", "T1021", "T1046", "T1053"], "exploit", ["T1190", "T1059", "T1003", "T1021", "T1046"], False),
    ],
)
def test_gates(spark, ids, summary, accepted, passed):
    df = spark.createDataFrame([(ids, summary)], "ids array<string>, summary string")
    got = gates.validate(df, "ids", "summary", registry()).first()
    assert (got.accepted, got.passed) == (accepted, passed)
    assert got.issue_count == len(got.issues)


def test_gate_issue_order_and_training_rows(spark):
    rows = [(["bad", "T1102", "T1003"], "A neutral sentence.", 1), (["T1190"], "exploit of a service", 2), (["T1102"], "A neutral sentence.", 3), (["T1190"], " ", 4)]
    made = gates.validate(spark.createDataFrame(rows, "ids array<string>, summary string, k int"), "ids", "summary", registry())
    assert [i.gate for i in made.where("k = 1").first().issues] == ["format", "semantic", "consistency"]
    assert [r.k for r in gates.training_rows(made, "ids", "summary").collect()] == [2]


def test_vector_search_matches_numpy_both_ways(spark):
    rng = np.random.default_rng(1)
    data = rng.normal(size=(300, 16)).astype("float32")
    rows = [(i, v.tolist()) for i, v in enumerate(data)] + [(900, None), (901, [1.0, 2.0]), (902, [0.0] * 16), (903, [float("nan")] * 16)]
    items = spark.createDataFrame(rows, "item long, v array<float>")
    queries = items.where("item % 100 = 0").select(F.col("item").alias("q"), F.col("v").alias("w"))
    unit = data / np.linalg.norm(data, axis=1, keepdims=True)
    for block in (50_000, 2):
        got = vectors.top_k(queries, items, 5, query_key="q", item_key="item", query_vector="w", item_vector="v", dim=16, skip_self=True, block=block).collect()
        for q in (0, 100, 200):
            scores = unit.astype(float) @ unit[q].astype(float)
            scores[q] = -9
            want = np.argsort(-scores, kind="stable")[:5].tolist()
            assert [r.item for r in sorted((r for r in got if r.q == q), key=lambda r: r.rank)] == want
    assert vectors.top_k(queries.limit(0), items, 5, query_key="q", item_key="item", query_vector="w", item_vector="v", dim=16).collect() == []
    assert vectors.top_k(queries, items.limit(0), 5, query_key="q", item_key="item", query_vector="w", item_vector="v").collect() == []


def test_cosine_column_and_size_check(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0], [0.0, 0.0])], "a array<double>, b array<double>, c array<double>")
    got = df.select(vectors.cosine("a", "b"), vectors.cosine("a", "c")).first()
    assert abs(got[0] - math.sqrt(0.5)) < 1e-12 and got[1] == 0.0
    with pytest.raises(Exception, match="expected 3"):
        df.select(vectors.sized("a", 3)).collect()


def test_composite_score_and_rerank(spark):
    pool = spark.createDataFrame([(1, "c1", 0.85, ["T1", "T2"]), (1, "c2", 0.80, ["T1", "T2"]), (1, "c3", 0.80, ["T1", "T2"])], "finding_id int, control_id string, similarity double, mitre_ids array<string>")
    mitigates = spark.createDataFrame([("c2", "T1"), ("c2", "T1"), ("c2", "T9")], "control_id string, technique_id string")
    provides = spark.createDataFrame([("Acme Cloud", "c3"), ("Base", "c3"), ("Base", "c1")], "vendor_name string, control_id string")
    best = correlate.composite_top_n(pool, mitigates, provides, allowed=[" ACME ", ""], framework="Base")
    got = {r.control_id: r for r in best.collect()}
    assert abs(got["c2"].score - 0.95) < 1e-9 and got["c2"].matched_mitre == ["T1"]
    assert got["c3"].vendor_matched and got["c3"].vendor == "Acme Cloud" and abs(got["c3"].score - 1.05) < 1e-9
    assert abs(got["c1"].score - 0.85) < 1e-9
    words = best.withColumn("f", F.array(F.lit("tls"))).withColumn("c", F.when(F.col("control_id") == "c1", F.array(F.lit("tls"))).otherwise(F.array(F.lit("ssh"))))
    again = {r.control_id: r.reranked for r in correlate.keyword_rerank(words, "f", "c").collect()}
    assert again == {"c3": 1, "c1": 2, "c2": 3}
    a, b = correlate.split_by_vendor(best, "Base")
    assert (a.count(), b.count()) == (1, 2)


def test_example_rerank(spark):
    rows = [("q", 0.9, 1, ["T1102"], "A vulnerable service with default credentials."), ("q", 0.7, 2, ["T1190"], "A vulnerable service with default credentials.")]
    df = spark.createDataFrame(rows, "query_id string, similarity double, rank int, labels array<string>, summary string")
    assert correlate.example_rerank(df).first().labels == ["T1190"]


def test_remap_chain_and_self(spark):
    pairs = spark.createDataFrame([("T1", "T2"), ("T2", "T3"), ("T5", "T5")], "old string, new string").where("old <> new")
    assert {(r.old, r.new) for r in remap.closed(pairs).collect()} == {("T1", "T3"), ("T2", "T3")}
    ids = F.array(*[F.lit(x) for x in ("t1", "T3", "T9.001", "X1", "T4.002", "T4.001")])
    allowed = ["T3", "T4"]
    got = spark.range(1).select(remap.normal_tags(ids, remap.map_column(pairs), allowed)).first()[0]
    assert got == ["T3", "T4.001", "T4.002"]
    objects = spark.createDataFrame([("attack-pattern", "a", "T1", None, None, None), ("attack-pattern", "b", "T2", None, None, None), ("relationship", "r", None, "revoked-by", "a", "b")], "type string, id string, technique_id string, relationship_type string, source_ref string, target_ref string")
    assert [tuple(r) for r in remap.deprecations(objects).collect()] == [("T1", "T2")]
    rows = spark.createDataFrame([("T4.001",), ("T8",), (None,)], "t string")
    assert [r.t for r in remap.allowed_rows(rows, "t", spark.createDataFrame([("t4",)], "a string"), "a").collect()] == ["T4.001"]


@pytest.fixture(scope="module")
def tagged(spark):
    rows = [(i, ["A"] if i < 50 else ["A", "B"] if i < 60 else ["C"]) for i in range(63)] + [(70, []), (71, None), (72, ["B", "B"])]
    return spark.createDataFrame(rows, "id long, tags array<string>")


def test_label_counts(tagged):
    assert {r.tag: r.n_rows for r in labels.histogram(tagged).collect()} == {"A": 60, "B": 11, "C": 3}
    assert {(r.tag_a, r.tag_b): r.n_rows for r in labels.co_occurrence(tagged).collect()} == {("A", "B"): 10, ("B", "A"): 10}
    assert [r.tag for r in labels.rarest(labels.histogram(tagged), 1).collect()] == ["C"]
    assert labels.cardinality_stats(tagged).first().max_tags == 2


def test_rebalancing(spark, tagged):
    counts = labels.histogram(tagged)
    kept = labels.head_cap(tagged, 5)
    after = {r.tag: r.n_rows for r in labels.histogram(kept).collect()}
    assert after["A"] <= 5 and after["C"] == 3 and kept.where("id >= 70").count() >= 2
    extra = {r.id: r.extra for r in labels.tail_copies(tagged, counts).collect()}
    assert extra[60] == 12 and extra[0] == 1 and labels.with_copies(tagged, labels.tail_copies(tagged, counts)).where("id = 60").count() == 13
    assert {r.extra for r in labels.frequency_copies(tagged, counts).collect()} == {0, 1, 3}
    weights = labels.inverse_weights(tagged, counts)
    assert abs({r.id: r.weight for r in weights.collect()}[60] - 1 / math.sqrt(3)) < 1e-9
    drawn = {r.id: r.copies for r in labels.weighted_resample(weights, 5000).collect()}
    share = {r.id: r.weight for r in weights.collect()}
    total = sum(share.values())
    assert sum(drawn.values()) == 5000 and all(abs(drawn.get(i, 0) - 5000 * w / total) < 1 + 1e-6 for i, w in share.items())
    found = {r.id: r.partner_id for r in labels.partner(tagged).collect()}
    tags = {r.id: set(r.tags or []) for r in tagged.collect()}
    assert all(p is None or (p != i and tags[p] & tags[i]) for i, p in found.items())
    exact = labels.holdout(spark.range(997).toDF("id"), "id").groupBy("split").count().collect()
    assert {r.split: r["count"] for r in exact} == {"holdout": 149, "train": 848}
    split = labels.hash_split(spark.range(20_000).toDF("id"), "id").groupBy("split").count().collect()
    assert abs({r.split: r["count"] for r in split}["holdout"] - 3000) < 200
    assert labels.shards(tagged, tagged.limit(2)).count() == tagged.count() + 8


def test_every_row_with_a_common_tag_has_a_partner(spark):
    rows = [(i, [f"pair{i // 2}"]) for i in range(40)] + [(100 + i, ["many"]) for i in range(300)] + [(500, ["alone"]), (501, None), (502, []), (503, ["alone2", "pair0"]), (504, [None]), (505, [None]), (None, ["alone"])]
    tagged = spark.createDataFrame(rows, "id int, tags array<string>")
    found = {r.id: r.partner_id for r in labels.partner(tagged).collect()}
    tags = {i: set(t or []) - {None} for i, t in rows if i is not None}
    assert {i for i, p in found.items() if p is None} == {500, 501, 502, 504, 505, None}
    assert all(p != i and tags[p] & tags[i] for i, p in found.items() if p is not None)


def test_metrics_by_hand(spark):
    rows = [(1, ["A", "B"], ["A"]), (2, ["A"], ["B"]), (3, ["C"], []), (4, [], ["A"]), (5, None, None)]
    df = spark.createDataFrame(rows, "id int, gold array<string>, pred array<string>")
    got = {r.label: r for r in metrics.per_label(df, spark.createDataFrame([("A",), ("B",), ("C",), ("Z",)], "label string")).collect()}
    assert (got["A"].tp, got["A"].fp, got["A"].fn) == (1, 1, 1) and got["A"].f1 == 0.5
    assert got["Z"].f1 == 0.0 and got["C"].recall == 0.0 and got["B"].support == 1
    total = metrics.overall(metrics.per_label(df)).first()
    assert abs(total.micro_f1 - 2 / (2 + 2 + 3)) < 1e-12 and abs(total.macro_f1 - 0.5 / 3) < 1e-12
    assert {(r.missed, r.given): r.n_rows for r in metrics.confusion(df).collect()} == {("A", "B"): 1}
    assert tuple(metrics.failures(df, ["B"]).first()) == (5, 2, 1)
    p = np.array([2, 1, 0]) / 3
    q = np.array([2, 1, 1]) / 4
    eps = 1e-12
    p, q = (p + eps) / (1 + 3 * eps), (q + eps) / (1 + 3 * eps)
    assert abs(metrics.divergence(df).first().kl - float((p * np.log(p / q)).sum())) < 1e-9
    assert metrics.tail_recall(df, spark.createDataFrame([("A",)], "label string")).first().recall == 0.5
    assert metrics.concentration(df).first().n_labels == 2


def test_graph(spark):
    stored = spark.createDataFrame([("c1", "old", 1), ("c2", "keep", 1)], "control_id string, body string, v int")
    incoming = spark.createDataFrame([("c1", "newer", 3, 2), ("c1", "new", 2, 1), ("c3", None, 1, 1)], "control_id string, body string, v int, at int")
    once = graph.upsert(stored, incoming, "control_id", [F.col("at")])
    twice = graph.upsert(once, incoming, "control_id", [F.col("at")])
    want = {("c1", "newer", 3), ("c2", "keep", 1), ("c3", None, 1)}
    assert {tuple(r) for r in once.collect()} == {tuple(r) for r in twice.collect()} == want
    rows = spark.createDataFrame([("V", "c", "s" * 3000, ["T1", None, "T1"]), ("V", "c", "other", ["T2"]), (" ", "c", None, None)], "vendor_name string, control_id string, description string, mitre_ids array<string>")
    nodes, links = graph.nodes_and_links(rows)
    kinds = {r["group"]: r["count"] for r in nodes.groupBy("group").count().collect()}
    assert kinds == {"Framework": 2, "Control": 2, "MITRE": 2} and links.count() == 4
    assert max(len(r.description or "") for r in nodes.collect()) <= 2000
    lone = graph.attach_orphans(spark.createDataFrame([("T1",), ("T8",), ("T9",)], "technique_id string"), links, spark.createDataFrame([("c1",), ("c2",)], "control_id string"))
    assert {(r.source, r.target) for r in lone.collect()} == {("c1", "T8"), ("c2", "T9")}
    controls, edges = graph.dense_fixture(spark)
    assert controls.count() == 225 and graph.violations(controls, "control_id").count() == 0 and edges.select("technique_id").distinct().count() <= 40
    assert [r.number for r in graph.numbered(spark.range(100).repartition(7), "id").orderBy("id").collect()] == list(range(100))
    two = graph.neighbourhood(spark.createDataFrame([("V",)], "vendor_name string"), spark.createDataFrame([("V", "c1")], "vendor_name string, control_id string"), spark.createDataFrame([("c1", "T1"), ("c2", "T2")], "control_id string, technique_id string"))
    assert {(r.node, r.hops) for r in two.collect()} == {("c1", 1), ("T1", 2)}


def test_verification(spark):
    step = (1, "Rotate keys", "sudo rotate AC-02", "because T1190 was used", "cli", None, ["open it", "run it", "verify it"])
    bare = (2, "Nothing", "ignore", "none", None, None, [])
    schema = f"k string, steps {verify.STEP}, source string, summary string, mitre_ids array<string>, best string, vendor_ids array<string>, framework_ids array<string>, references array<string>"
    rows = [("good", [step], "rotate keys now", "rotate keys", ["T1190"], "AC-02", ["AC-02"], None, ["AC-02.1"]), ("half", [step, bare], "rotate", "rotate printers", ["T1190", "T2"], "A", ["B"], ["C", "D"], ["A"]), ("none", [], "x", "y", None, None, None, None, [])]
    got = {r.k: r for r in verify.verdict(spark.createDataFrame(rows, schema)).collect()}
    assert (got["good"].grounding, got["good"].relevance, got["good"].completeness, got["good"].substep_quality, got["good"].passed) == (1.0, 1.0, 1.0, 1.0, True)
    assert (got["half"].grounding, got["half"].relevance, got["half"].completeness, got["half"].substep_quality, got["half"].passed) == (0.5, 0.5, 0.3333, 0.5, False)
    assert (got["none"].grounding, got["none"].relevance, got["none"].completeness, got["none"].passed) == (0.0, 0.0, 1.0, False)
    assert "[substep_quality/error] Step 2: no substeps" in got["half"].issues
    verdicts = spark.createDataFrame([(["SUPPORTED", "partially_supported: x", "NO"],)], "v array<string>").select(verify.judged("v")).first()[0]
    assert verdicts == 0.5


def test_retries_cover_only_failures(spark):
    rows = spark.createDataFrame([(i,) for i in range(6)], "k int")
    made = verify.retried(rows, lambda df, attempt: df.withColumn("attempt", F.lit(attempt)), lambda df: df.withColumn("passed", F.col("k") <= F.col("attempt") * 2), 2)
    assert {r.k: r.attempts for r in made.collect()} == {0: 1, 1: 2, 2: 2, 3: 3, 4: 3, 5: 3}


def test_resume_and_cache(spark):
    work = spark.createDataFrame([("a", 0), ("a", 1), ("b", None)], "p string, i int")
    log = spark.createDataFrame([("a", 0, "ok"), ("a", 1, "error"), ("b", None, "ok")], "p string, i int, status string")
    assert [(r.p, r.i) for r in state.pending(work, log, ["p", "i"]).collect()] == [("a", 1)]
    keys = spark.createDataFrame([("x",), ("y",)], "key string")
    cache = spark.createDataFrame([("x", "s")], "key string, summary string")
    assert tuple(state.hit_rate(state.cache_lookup(keys, cache)).first()) == (1, 1, 0.5)
    assert state.hit_rate(state.cache_lookup(keys.limit(0), cache)).first().hit_rate == 0.0


def test_dedup_prefers_local(spark):
    rows = [(1, "a  b", ["T1059"], "corpus"), (2, "a b", ["t1059 ", "T1059"], "local"), (3, " ", ["T1059"], "local"), (4, "c", [], "local"), (5, "a b", ["T1003"], "corpus")]
    df = spark.createDataFrame(rows, "n int, s string, ids array<string>, source string")
    got = dedup.seed_records(df, summary="s", ids="ids", local=F.col("source") == "local", order=[F.col("n")])
    assert sorted(r.n for r in got.collect()) == [2, 5]


def test_coverage_states(spark):
    catalog = spark.createDataFrame([("T1", "x"), ("T2", "x"), ("T3", "y")], "technique_id string, tactic string")
    mapped = spark.createDataFrame([("f1", "T1"), ("f2", "T2"), ("f3", "T2"), ("f1", "T9"), ("f1", "T1")], "finding_id string, technique_id string")
    cells = stats.coverage(catalog, mapped, spark.createDataFrame([("f1",), ("f2",)], "finding_id string"))
    assert {r.technique_id: (r.tactic, r.state) for r in cells.collect()} == {"T1": ("x", "green"), "T2": ("x", "red"), "T3": ("y", "neutral"), "T9": ("Unmapped", "green")}
    columns = {r.tactic: (r.place, r.technique_ids) for r in stats.by_tactic(cells, ["y", "x"]).collect()}
    assert columns == {"y": (1, ["T3"]), "x": (2, ["T1", "T2"]), "Unmapped": (3, ["T9"])}
    assert stats.readiness(None, "v", 2, 1) == "missing"
    vec = spark.createDataFrame([([1.0, 2.0],), (None,)], "v array<double>")
    assert (stats.readiness(vec.limit(0), "v", 2, 1), stats.readiness(vec, "v", 2, 5), stats.readiness(vec, "v", 2, 1), stats.readiness(vec.where("v is not null"), "v", 2, 1)) == ("empty", "too few", "wrong size", "ready")
    assert {r.technique_id: r.n_findings for r in stats.technique_findings(mapped).collect()} == {"T1": 1, "T2": 2, "T9": 1}
    many = spark.range(1500).select(F.lit("T1").alias("technique_id"), F.col("id").cast("string").alias("finding_id"))
    rows = stats.technique_findings(many.union(many))
    assert rows.count() == 1500 and {r.n_findings for r in rows.select("n_findings").distinct().collect()} == {1500}


def test_fixed_words_are_lower_case():
    assert all(w == w.lower() for words in fixed.TACTIC_WORDS.values() for w in words)


STEPS = "k int, " + "steps " + verify.STEP + ", source string, summary string, ids array<string>, top array<string>, refs array<string>, lifted boolean"


def step(n, text, *subs, crumb=None, command=None):
    return (n, text, command or text, "", None, crumb, list(subs))


def test_step_words_are_their_own(spark):
    row = spark.createDataFrame([("Configure the NETWORK port, disable c:\\windows",)], "t string").select(text.step_tokens("t"), text.tokens("t")).first()
    assert sorted(row[0]) == ["\\windows", "network", "port"]
    assert "network" not in row[1] and "configure" in row[1]


def test_lift_and_issues(spark):
    rows = [
        (1, [step(1, "Close the port", "Open it", "Close it", "Verify that it is closed", crumb="Settings")], "close port", "port stays open", ["T1"], ["a"], [], True),
        (2, [step(1, "Close the port", "Open it")], "other words", "unlike", ["T1"], ["a", "b", "c"], ["a-1"], True),
        (3, [], "x", "y", [], ["a"], [], None),
        (4, None, "x", "y", None, ["a"], None, False),
    ]
    df = spark.createDataFrame(rows, STEPS)
    got = {r.k: r for r in df.select("k", verify.completeness(F.col("top"), "refs", F.col("lifted")).alias("c"), verify.issues("steps", "source", "summary", "ids", F.col("top"), "refs").alias("i")).collect()}
    assert [got[k].c for k in (1, 3)] == [0.5, 0.0] and abs(got[2].c - 1 / 3) < 1e-9
    assert got[1].i == ["[relevance/warning] techniques not named: T1", "[completeness/warning] top controls not used: a"]
    assert any(x.startswith("[grounding/warning] Step 1") for x in got[2].i) and "[substep_quality/warning] Step 1: no confirmation" in got[2].i
    assert "[grounding/error] no steps" in got[3].i and "[grounding/error] no steps" in got[4].i


def test_retry_sees_the_issues(spark):
    seen = []

    def generate(df, attempt):
        seen.append({r.k: r.issues for r in df.collect()})
        return df.withColumn("attempt", F.lit(attempt))

    def check(df):
        return df.drop("issues").withColumn("passed", F.col("k") <= F.col("attempt")).withColumn("issues", F.array(F.concat(F.lit("k "), F.col("k").cast("string"))))

    made = verify.retried(spark.createDataFrame([(0,), (1,), (9,)], "k int"), generate, check, 2)
    assert {r.k: (r.attempts, r.passed) for r in made.collect()} == {0: (1, True), 1: (2, True), 9: (3, False)}
    assert seen == [{0: None, 1: None, 9: None}, {1: ["k 1"], 9: ["k 9"]}, {9: ["k 9"]}]


def test_latest_breaks_ties_by_the_row(spark):
    rows = [(1, 5, "b", ["x"]), (1, 5, "a", ["z"]), (1, None, "z", None), (2, None, None, None)]
    df = spark.createDataFrame(rows, "id int, at int, t string, l array<string>")
    for made in (df, df.repartition(3)):
        assert sorted(map(tuple, latest(made, ["id"], [F.col("at")]).collect())) == [(1, 5, "b", ["x"]), (2, None, None, None)]


def test_vector_dimension_is_the_common_one(spark):
    items = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 0.0, 0.0]), (4, None), (5, [float("nan"), 1.0]), (6, [0.0, 0.0])], "i long, v array<double>")
    queries = spark.createDataFrame([(10, [1.0, 0.1]), (11, [1.0, 2.0, 3.0])], "q long, w array<double>")
    for block in (100, 2, 1):
        got = vectors.top_k(queries, items, 2, query_key="q", item_key="i", query_vector="w", item_vector="v", block=block).collect()
        assert [(r.q, r.i, r["rank"]) for r in sorted(got, key=lambda r: r["rank"])] == [(10, 1, 1), (10, 2, 2)]
    none = items.where("i > 100")
    assert vectors.top_k(none.withColumnRenamed("i", "q"), none, 2, query_key="q", item_key="i", query_vector="v", item_vector="v").collect() == []


def test_vector_blocks_agree_with_brute_force(spark):
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=(40, 8)), rng.normal(size=(300, 8))
    q = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(a)], "q long, w array<float>")
    t = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(b)], "i long, v array<float>").repartition(5)
    sim = (a / np.linalg.norm(a, axis=1, keepdims=True)) @ (b / np.linalg.norm(b, axis=1, keepdims=True)).T
    want = {(i, int(j)) for i in range(40) for j in np.argsort(-sim[i])[:7]}
    for block in (1000, 16):
        got = vectors.top_k(q, t, 7, query_key="q", item_key="i", query_vector="w", item_vector="v", block=block).collect()
        assert {(r.q, r.i) for r in got} == want


def test_cache_takes_valid_model_summaries_only(spark):
    good, other = "The remote service accepts weak ciphers on its port.", "The remote service leaks the names of its users."
    cache = spark.createDataFrame([("k1", good)], "key string, summary string")
    made = spark.createDataFrame([("k1", other, "model"), ("k2", other, "model"), ("k3", other, "plain"), ("k4", "bad", "model"), (None, other, "model"), ("k2", other, "model")], "key string, summary string, summary_source string")
    assert sorted(map(tuple, state.cache_put(cache, made).collect())) == [("k1", good), ("k2", other)]


def test_registry_joins(spark):
    registry = spark.createDataFrame([("t1059",), ("T1190",), (None,)], "t string")
    assert gates.registry_ids(registry, "t") == ["T1059", "T1190"]
    with pytest.raises(ValueError):
        gates.registry_ids(registry, "t", most=1)
    rows = spark.createDataFrame([(1, ["T1059.001", "T1190", "T9999", None]), (2, []), (3, None)], "k int, ids array<string>")
    assert {r.k: r.known_ids for r in gates.known_by_join(rows, "k", "ids", registry, "t").collect()} == {1: ["T1059.001", "T1190"], 2: [], 3: []}
    objects = spark.createDataFrame([("attack-pattern", "T1", False, None), ("attack-pattern", "t1", None, None), ("attack-pattern", "T2", True, None), ("attack-pattern", "T3", None, True), ("malware", "T4", None, None)], "type string, technique_id string, revoked boolean, x_mitre_deprecated boolean")
    assert [r.technique_id for r in gates.bundle_ids(objects).collect()] == ["T1"]
