import numpy as np
from pyspark.sql import functions as F

from sievemill.llm import sampling

TARGETS = [("T1", 0.6, 5), ("T2", 0.3, 2), ("T3", 0.1, 40), ("T4", 0.0, 1), ("T5", None, None)]


def mappings(spark, n=4000):
    kind = F.when(F.col("id") % 10 < 6, "t1.001").when(F.col("id") % 10 < 9, " T2 ").when(F.col("id") < 200, "T3")
    return spark.range(n).select(F.col("id").alias("mapping_id"), F.array(F.lit(None), F.lit(" "), kind, F.lit("T9")).alias("mitre_ids"), F.lit(None).cast("timestamp_ntz").alias("mapped_at"), F.lit("x").alias("category"), F.lit(1).alias("p"))


def draw(spark, df, **more):
    targets = spark.createDataFrame(TARGETS + TARGETS[:1], "technique_id string, target_share double, min_rows int")
    return sampling.draw(df, "mapping_id", sampling.first_category(F.col("mitre_ids")), targets, order="mapped_at", **more)


def test_shares_floors_and_report(spark):
    df = mappings(spark)
    made = draw(spark, df.union(df.limit(500)))
    rows = made.rows.collect()
    assert len({r.id for r in rows}) == len(rows)
    report = {r.technique_id: r for r in made.report.collect()}
    assert set(report) == {"T1", "T2", "T3", "T4", "T5"}
    assert report["T3"].available == 20 and report["T3"].drawn_rows == 20 and not report["T3"].met and report["T3"].short_of == "share and floor"
    assert not report["T4"].met and report["T4"].drawn_rows == 0
    assert report["T5"].met and report["T1"].met and report["T2"].met
    assert abs(len(rows) - 400) <= 2
    assert abs(report["T1"].drawn_rows / report["T2"].drawn_rows - 2) < 0.05
    assert {r.category for r in rows} == {"T1", "T2", "T3"}


def test_same_sample_for_any_partitioning(spark):
    a = {r.id for r in draw(spark, mappings(spark)).rows.collect()}
    b = {r.id for r in draw(spark, mappings(spark).repartition(7)).rows.collect()}
    assert a == b


def test_empty_tables(spark):
    made = draw(spark, mappings(spark).limit(0))
    assert made.rows.collect() == [] and {r.available for r in made.report.collect()} == {0}
    none = spark.createDataFrame([], "technique_id string, target_share double, min_rows int")
    made = sampling.draw(mappings(spark), "mapping_id", sampling.first_category(F.col("mitre_ids")), none)
    assert made.rows.collect() == [] and made.report.collect() == []


def test_first_category(spark):
    rows = [([None, "", " t1059.001 ", "T2"],), ([],), (None,), (["\t"],)]
    got = [r[0] for r in spark.createDataFrame(rows, "ids array<string>").select(sampling.first_category(F.col("ids"))).collect()]
    assert got == ["T1059", None, None, None]


def test_expected_sizes():
    got = sampling.expected_sizes(np.array([0.5, 0.5]), np.array([0.0, 0.0]), np.array([10.0, 1000.0]), 100)
    assert np.allclose(got, [10, 90], atol=1e-6)
    assert len(sampling.expected_sizes(np.array([]), np.array([]), np.array([]), 10)) == 0


def brute_force(shares, floors, available, size):
    """Share x size within floor and supply; what is lacking below the size goes to the others by share, a little at a time."""
    got = [min(a, max(f, s * size)) for s, f, a in zip(shares, floors, available)]
    scale = 1.0
    while sum(got) < size - 1e-6 and scale < 1e4:
        scale *= 1.0005
        got = [min(a, max(f, s * size * scale)) for s, f, a in zip(shares, floors, available)]
    return got


def test_expected_sizes_agree_with_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(60):
        k = int(rng.integers(1, 8))
        shares = rng.dirichlet(np.ones(k))
        floors, available = rng.integers(0, 60, k).astype(float), rng.integers(0, 400, k).astype(float)
        got = sampling.expected_sizes(shares, floors, available, 200)
        assert np.allclose(got, brute_force(shares, floors, available, 200), rtol=2e-3, atol=0.2)


def floors_case(spark, floor):
    """One category of 0.9 without a floor, a hundred of 0.001 with one; 20,000 rows, asked for 1,000."""
    small = F.concat(F.lit("S"), (F.col("id") % 100).cast("string"))
    rows = spark.range(20_000).select(F.col("id").alias("mapping_id"), F.when(F.col("id") < 10_000, F.lit("BIG")).otherwise(small).alias("c"))
    targets = spark.createDataFrame([("BIG", 0.9, 0)] + [(f"S{i}", 0.001, floor) for i in range(100)], "technique_id string, target_share double, min_rows int")
    made = sampling.draw(rows, "mapping_id", F.col("c"), targets, one_in=20)
    return {r.technique_id: r for r in made.report.collect()}, made.rows.count()


def test_floors_above_the_size_starve_nobody(spark):
    report, n = floors_case(spark, 30)
    assert report["BIG"].drawn_rows == 900 and report["BIG"].met and not report["BIG"].share_met
    assert all(report[f"S{i}"].drawn_rows == 30 for i in range(100)) and n == 3900
    report, n = floors_case(spark, 5)
    assert report["BIG"].drawn_rows == 900 and n == 1400 and not report["BIG"].share_met
    report, n = floors_case(spark, 0)
    assert report["BIG"].share_met and 990 <= n <= 1010


def test_report_speaks_of_the_rows_drawn(spark):
    made = draw(spark, mappings(spark))
    drawn = {r.category: r.n for r in made.rows.groupBy("category").agg(F.count("*").alias("n")).collect()}
    for r in made.report.collect():
        n = drawn.get(r.technique_id, 0)
        assert r.drawn_rows == n
        assert r.met == (n >= r.min_rows and n > r.wanted_rows - 1 and not (n == r.available and n < r.wanted_rows))
