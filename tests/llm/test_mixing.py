import numpy as np
import pytest
from pyspark.sql import functions as F

from sievemill.llm import mixing, queries


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("fetched_at", F.lit(None).cast("timestamp_ntz")).withColumn("n_tokens", F.lit("clash"))


@pytest.fixture(scope="module")
def corpus():
    rows = [(i, "word " * (5 + i % 40), " Big ") for i in range(600)]
    rows += [(1000 + i, "word " * 30, "small") for i in range(20)]
    return rows + [(2000, None, "small"), (2001, "", "big"), (2002, "odd words here", "unlisted"), (2003, "no source", None), (0, "word " * 5, " Big ")]


WEIGHTS = [("big", 0.5, 2), ("SMALL", 0.3, 3), ("absent", 0.2, 9), ("big", 0.5, 2)]


def weights(spark, rows=WEIGHTS):
    return spark.createDataFrame(rows, "source string, target_share double, max_repeats int")


def test_shares_caps_and_report(spark, corpus):
    mixed = mixing.mix(documents(spark, corpus), weights(spark), shards=5)
    report = {r.source: r for r in mixed.report.collect()}
    assert report["big"].reachable and not report["small"].reachable and not report["absent"].reachable
    total = report["big"].total_tokens
    rows = mixed.sample.collect()
    used = {}
    for r in rows:
        used.setdefault(r.doc_id, []).append(r.copy_no)
    assert all(len(set(c)) == len(c) for c in used.values())
    small = [c for d, c in used.items() if 1000 <= d < 2000]
    assert len(small) == 20 and all(len(c) == 3 for c in small)
    big = sum(r.n_tokens for r in rows if r.source == "big")
    assert 0 <= 0.5 * total - big <= 60
    assert {r.shard for r in rows} <= set(range(5))
    told = {r.source: r for r in mixing.shares(mixed).collect()}
    assert told["big"].tokens_reached == big and told["small"].uses_of_a_document == 3 and told["absent"].tokens_reached == 0
    assert abs(sum(r.actual_share for r in told.values()) - 1) < 1e-9


def test_repeatable(spark, corpus):
    one = {(r.doc_id, r.copy_no, r.shard) for r in mixing.mix(documents(spark, corpus), weights(spark)).sample.collect()}
    two = {(r.doc_id, r.copy_no, r.shard) for r in mixing.mix(documents(spark, corpus).repartition(3), weights(spark)).sample.collect()}
    assert one == two


def test_empty_tables(spark, corpus):
    none = mixing.mix(documents(spark, []), weights(spark))
    assert none.sample.collect() == [] and all(r.reachable for r in none.report.collect())
    assert mixing.shares(none).count() == 3
    assert mixing.mix(documents(spark, corpus), weights(spark, [])).report.collect() == []
    odd = mixing.mix(documents(spark, corpus), weights(spark, [("big", None, None), (None, 0.5, 1)]))
    assert odd.sample.collect() == []


def test_p7_found_draws_the_sample(spark, corpus, monkeypatch):
    real, made = mixing.cut, []
    monkeypatch.setattr(mixing, "cut", lambda df: made.append(df.columns) or real(df))
    monkeypatch.setattr(queries, "table", lambda s, d, name: documents(s, corpus) if name == "documents" else weights(s))
    assert sorted(r.source for r in queries.p7_found(spark, "").collect()) == ["absent", "small"]
    assert any("shard" in columns for columns in made)


def test_uses_stay_bounded_and_cover_the_quota():
    rng = np.random.default_rng(3)
    totals = {b: (int(rng.integers(1, 50)), 3) for b in range(0, mixing.BLOCKS, 3)}
    available = sum(t for t, _ in totals.values())
    order = rng.permutation(mixing.BLOCKS)
    for passes, room in ((0, 5000), (3, 5000), (40, 5000), (4000, 5000), (1_000_000, 5000)):
        rest = available // 3
        uses, width, last = mixing.uses_of(totals, order, passes, rest, room)
        assert len(uses) <= 2 * room + 2
        wide = {}
        for b, (t, _) in totals.items():
            wide[b // width] = wide.get(b // width, 0) + t
        seen, reached = set(), 0
        for b, first, copies in uses:
            assert all((b, c) not in seen for c in (first, first + copies - 1))
            seen |= {(b, first), (b, first + copies - 1)}
            reached += wide[b] * copies
        if last:
            reached += last[1] - wide[last[0]]
        assert reached == passes * available + rest


def test_a_tiny_source_repeated_very_often(spark):
    rows = [(1, "one two three four", "tiny"), (2, "five six", "tiny")] + [(10 + i, "word " * 50, "big") for i in range(40)]
    w = weights(spark, [("tiny", 0.5, 1_000_000), ("big", 0.5, 1)])
    mixed = mixing.mix(documents(spark, rows), w, total_tokens=4000)
    told = {r.source: r for r in mixing.shares(mixed).collect()}
    assert told["tiny"].reachable and told["tiny"].tokens_wanted - told["tiny"].tokens_reached <= 6
    assert mixed.sample.groupBy("doc_id", "copy_no").count().where("count > 1").count() == 0


def test_invariants_of_the_sample(spark, corpus):
    mixed = mixing.mix(documents(spark, corpus), weights(spark))
    rows = mixed.sample
    assert rows.groupBy("doc_id", "copy_no").count().where("count > 1").count() == 0
    assert rows.rdd.getNumPartitions() == mixing.LEAST_SHARDS
    reached = {r.source: r.t for r in rows.groupBy("source").agg(F.sum("n_tokens").alias("t")).collect()}
    for r in mixed.report.collect():
        assert r.tokens_reached == reached.get(r.source, 0) <= r.tokens_quota
        assert r.tokens_quota - r.tokens_reached <= 50  # to within a document
        assert r.reachable == (r.target_share * r.total_tokens <= r.max_repeats * r.tokens_available)
