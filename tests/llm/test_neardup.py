import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sievemill.llm import neardup, overlap

WORD = re.compile("[a-z0-9]+")


def bag(text):
    return frozenset(WORD.findall((text or "").lower()))


def alike(a, b):
    return len(a & b) >= 0.7 * len(a | b) - 1e-9 and bool(a)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(4000)]
    made = []
    for i in range(150):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(12, 60))]
        made.append(" ".join(base))
        for _ in range(rng.choice([0, 0, 1, 3])):
            copy = [w if rng.random() > rng.choice([0.02, 0.1, 0.2]) else rng.choice(vocabulary) for w in base]
            rng.shuffle(copy)
            made.append(", ".join(copy).upper())
    made += [made[0]] * 5 + [None, "", "  ", "short text", "same same same"]
    return [(i, t) for i, t in enumerate(made)]


def brute(texts, least=10):
    bags = [(i, bag(t)) for i, t in texts]
    bags = [x for x in bags if len(x[1]) >= least]
    return {(i, j) for n, (i, a) in enumerate(bags) for j, b in bags[n + 1 :] if alike(a, b)}


def pairs_of(found):
    return {(r.a, r.b) for r in neardup.id_pairs(found, "a", "b").collect()}


@pytest.mark.parametrize("cap", [neardup.BUCKET_CAP, 2])
def test_all_pairs_also_with_full_buckets(spark, texts, cap):
    df = spark.createDataFrame(texts, "id long, body string").withColumn("class_id", F.lit("clash")).withColumn("words", F.lit(1))
    found = neardup.find(df, "id", F.col("body"), min_words=10, cap=cap)
    got, want = pairs_of(found), brute(texts)
    assert not got - want
    assert len(want - got) <= 0.01 * len(want)


def test_counts_and_groups(spark, texts):
    found = neardup.find(spark.createDataFrame(texts, "id long, body string"), "id", F.col("body"), min_words=10)
    pairs = pairs_of(found)
    degree = {}
    for a, b in pairs:
        degree[a] = degree.get(a, 0) + 1
        degree[b] = degree.get(b, 0) + 1
    counted = {r.id: r for r in neardup.counts(found).collect()}
    assert {i: r.n_links for i, r in counted.items() if r.n_links} == degree
    assert counted[0].copies == 6
    parent = {i: i for i in counted}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        parent[root(a)] = root(b)
    member = {r.id: r.class_id for r in found.members.collect()}
    group = {r.class_id: r.group_id for r in neardup.groups(found.links).collect()}
    mine, truth = {}, {}
    for i in counted:
        mine.setdefault(group.get(member[i], member[i]), set()).add(i)
        truth.setdefault(root(i), set()).add(i)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, truth.values()))


def test_latest_delivery_counts_once(spark):
    long = " ".join(f"k{i}" for i in range(20))
    rows = [("a", long, 1), ("a", "gone", 2), ("b", long, 1), ("b", long, 1), ("c", long, None), (None, long, 1)]
    df = spark.createDataFrame(rows, "id string, body string, at long").withColumn("at", F.timestamp_seconds("at").cast("timestamp_ntz"))
    found = neardup.find(df, "id", F.col("body"), min_words=10, order="at")
    assert pairs_of(found) == {("b", "c")}


def test_empty_table(spark):
    found = neardup.find(spark.createDataFrame([], "id long, body string"), "id", F.col("body"))
    assert pairs_of(found) == set() and neardup.counts(found).collect() == [] and neardup.groups(found.links).collect() == []


def test_one_long_text_and_one_word(spark):
    big = " ".join(f"x{i}" for i in range(30_000))
    found = neardup.find(spark.createDataFrame([(1, big), (2, big + " more"), (3, "one"), (4, "ONE!")], "id long, body string"), "id", F.col("body"))
    assert pairs_of(found) == {(1, 2), (3, 4)}


def test_signatures_agree_with_similarity():
    rng = np.random.default_rng(2)
    shared, n = 140, 170  # J = 140 / 200
    a = rng.integers(0, 2**63, 2 * n - shared).astype(np.uint64)
    both = np.concatenate([a[:n], np.concatenate([a[:shared], a[n:]])])
    sig = neardup.signatures(both, np.array([n, n]), 2048)
    assert abs((sig[0] == sig[1]).mean() - 0.7) < 0.07


def test_cross_split_only(spark, texts):
    rng = random.Random(9)
    rows = [(i, t, rng.choice(["train", "Train", "test", "HOLDOUT", None]), rng.choice(["x", "y"]), rng.choice([["T1190"], None, ["t1190 "]])) for i, t in texts]
    df = spark.createDataFrame(rows, "report_id long, technical_summary string, split_name string, source_name string, mitre_ids array<string>").withColumn("added_at", F.lit(None).cast("timestamp_ntz"))
    found = overlap.cross_split(df)
    side = {r[0]: None if r[2] is None else r[2].lower() == "train" for r in rows}
    want = {(a, b) for a, b in brute(texts) if None not in (side[a], side[b]) and side[a] != side[b]}
    got = {(r.report_id_a, r.report_id_b) for r in overlap.id_pairs(found).collect()}
    assert not got - want and len(want - got) <= 0.02 * len(want)
    report = overlap.report(df, found).collect()
    assert sum(r.pairs for r in report) == len(got)
    assert sum(r.records for r in report) == sum(1 for s in side.values() if s is False)


def test_no_reports(spark):
    df = spark.createDataFrame([], "report_id long, technical_summary string, split_name string, source_name string, mitre_ids array<string>, added_at timestamp_ntz")
    found = overlap.cross_split(df)
    assert overlap.id_pairs(found).collect() == [] and overlap.report(df, found).collect() == []


def candidates(keys, ids, low, high, cap=None, batch=1 << 20):
    columns = [keys, ids, np.zeros_like(ids), low, high]
    whole = pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in columns], names=["key", "c1", "c2", "low", "high"])
    parts = [whole.slice(at, batch) for at in range(0, len(keys), batch)]
    found, large = set(), []
    for out in neardup._pair_batches(0.7, cap, False)(iter(parts)):
        a = neardup.keys_of(out.column("a"))[:, 0].tolist()
        if out.column("b").null_count:
            large += a
        else:
            found |= set(zip(a, neardup.keys_of(out.column("b"))[:, 0].tolist(), strict=True))
    return found, large


@pytest.mark.parametrize(("union", "shared"), [(10, 7), (20, 14), (40, 28), (200, 140)])
def test_recall_at_the_threshold(union, shared):
    n, half = 4000, (union - shared) // 2
    words = np.random.default_rng(union).integers(0, 2**63, (n, union)).astype(np.uint64)
    left, right = words[:, : shared + half], np.concatenate([words[:, :shared], words[:, shared + half :]], 1)
    flat = [(w.reshape(-1), np.full(n, w.shape[1])) for w in (left, right)]
    sides = [neardup.band_keys(neardup.signatures(*f, neardup.BANDS * neardup.ROWS), neardup.BANDS, neardup.ROWS) for f in flat]
    met = np.equal(*sides).any(axis=1)
    assert (~met).mean() < 0.002  # 0.001 and room for chance
    low, high = (np.stack(x, 1).reshape(-1) for x in zip(*(neardup.sketches(*f, np.ones(n, int)) for f in flat), strict=True))
    passed, _ = candidates(np.repeat(np.arange(n), 2), np.arange(2 * n), low, high)
    assert passed == {(2 * i, 2 * i + 1) for i in range(n)}  # the sketch loses no pair


def test_sketch_stops_unlike_pairs():
    rng = np.random.default_rng(5)
    words = rng.integers(0, 2**63, (500, 60)).astype(np.uint64)
    words[:, :30] = words[0, :30]  # similarity 1/3
    low, high = neardup.sketches(words.reshape(-1), np.full(500, 60), np.ones(500, int))
    passed, _ = candidates(np.zeros(500, int), np.arange(500), low, high)
    assert len(passed) < 0.01 * 500 * 499 / 2


@pytest.mark.parametrize("batch", [3, 7, 100])
def test_runs_across_batches(batch):
    keys = np.array([1] * 2 + [2] * 9 + [3] * 3 + [4])
    ids = np.array([1, 2, *range(10, 19), 1, 2, 2, 1])
    size = np.full(len(keys), 30 << 48)
    found, large = candidates(keys, ids, np.zeros(len(keys), int), size, cap=5, batch=batch)
    assert found == {(1, 2)} and sorted(large) == list(range(10, 19))


def test_word_sets_agree_with_the_definition():
    texts = ["", None, "a b a", "é-x9_x9 zz", "łódź", "one\x00two  one", "x" * 5000 + " y", "end", "end"]
    values, sizes = neardup.word_sets(pa.array(texts, pa.string()).slice(0))
    assert sizes.tolist() == [len(bag(t)) for t in texts]
    lists = np.split(values, np.cumsum(sizes)[:-1])
    assert set(lists[-1]) == set(lists[-2]) and not set(lists[-1]) & set(lists[2])
    again, cut = neardup.word_sets(pa.array(texts, pa.string()).slice(2, 3))
    assert cut.tolist() == sizes[2:5].tolist() and (again == np.concatenate(lists[2:5])).all()
    keys = neardup.set_keys(values, sizes[sizes > 0])
    assert (keys[-1] == keys[-2]).all() and len({tuple(k) for k in keys}) == 6


def test_many_near_copies_in_one_bucket(spark):
    rng = random.Random(4)
    base = [f"b{i}" for i in range(80)]
    rows = [(i, " ".join([f"u{i}", *base[:40], *(rng.choice(base[40:]) for _ in range(3)), f"v{i}", *(f"p{i}x{j}" for j in range(18))])) for i in range(3000)]
    rows += [(100_000 + i, " ".join([*base, f"u{i}"])) for i in range(60)]
    found = neardup.find(spark.createDataFrame(rows, "id long, body string"), "id", F.col("body"), cap=20)
    got = pairs_of(found)
    assert got == {(100_000 + i, 100_000 + j) for i in range(60) for j in range(i + 1, 60)}
