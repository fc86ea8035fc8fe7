import numpy as np
from pyspark.sql import functions as F

from sievemill.llm import gbrt, readlevel

PLAIN = "Please lock your screen each day. Do not open a bad link. Ask the help desk first, and be kind. " * 12
HARD = "Insufficient attention has been devoted to the circumstance that configurational complexity, to the extent that institutional incentives privilege expedient containment, circumvents the empirical validation of behavioural detection hypotheses, notwithstanding repeated exhortations to the contrary. " * 6


def test_trees_fit_and_extrapolate_flat():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 5))
    y = np.where(x[:, 2] > 0, 3.0, 1.0) + 0.5 * (x[:, 0] > 1)
    model, held = gbrt.cross_validated(x, y, np.arange(300) % 5)
    assert ((held - y) ** 2).mean() < 0.1
    assert np.allclose(model.predict(np.full((1, 5), 50.0)), model.predict(np.full((1, 5), 500.0)))


def test_constant_and_tiny_training():
    x = np.zeros((3, 2))
    assert np.allclose(gbrt.fit(x, np.ones(3)).raw(x), 1.0)


def test_held_out_accuracy(spark, sf_dir):
    model, held = readlevel.train(spark.read.parquet(f"{sf_dir}/level_examples.parquet"))
    assert (np.round(held.held_out) == held.level).mean() > 0.95


def test_kinds_and_levels(spark, sf_dir):
    model, _ = readlevel.train(spark.read.parquet(f"{sf_dir}/level_examples.parquet"))
    german = "Der Dienst antwortet ohne Anmeldung und der Angreifer kann die Daten lesen. " * 20
    listing = "\n".join(f"GET /a{i}/b{i}?id={i} 200 {i}" for i in range(60))
    rows = [(1, PLAIN), (2, HARD), (3, german), (4, listing), (5, None), (6, "  "), (7, "Too short to say."), (8, HARD * 50), (9, "…!?")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("level", F.lit("clash")).withColumn("grade", F.lit(9))
    got = {r.doc_id: r for r in readlevel.score(df, model, keep=["doc_id"]).collect()}
    assert {i: r.kind for i, r in got.items()} == {1: "prose", 2: "prose", 3: "other_language", 4: "listing", 5: "empty", 6: "empty", 7: "short", 8: "prose", 9: "empty"}
    assert got[1].grade == 1 and got[2].grade == 4 and got[8].grade == 4 and got[5].level is None


def test_empty_tables(spark):
    model, held = readlevel.train(spark.createDataFrame([], "example_id long, text string, reading_level int"))
    assert held.empty
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    scored = readlevel.score(docs, model, keep=["doc_id", "source"])
    assert scored.collect() == [] and readlevel.profile(scored).collect() == []
