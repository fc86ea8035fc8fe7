import random

import pytest
from pyspark.sql import functions as F

from sievemill.llm import splitting

PROGRESS = "entry_id long, pdf_path string, batch_index int, start_page int, end_page int, status string, detail string, logged_at long"


def progress(spark, rows):
    return spark.createDataFrame(rows, PROGRESS).withColumn("logged_at", F.timestamp_seconds("logged_at").cast("timestamp_ntz"))


def rebuilt(pieces, overlap):
    text = pieces[0]
    for before, piece in zip(pieces, pieces[1:], strict=False):
        assert piece[:overlap] == before[-overlap:]
        text += piece[overlap:]
    return text


@pytest.mark.parametrize("seed", range(6))
def test_pack_round_trip(seed):
    rng = random.Random(seed)
    pages = ["".join(rng.choice(["word ", "x", ". ", "\n", "\n\n", "ä", "字", "# Head\n"]) for _ in range(rng.choice([0, 5, 400, 3000]))) for _ in range(8)]
    pages[3] = "u" * 2500
    packer, out = splitting.Packer(500, 60), []
    for i, page in enumerate(pages):
        out += packer.add(i, page)
    out += packer.close()
    assert all(len(t) <= 500 for _, _, t in out)
    assert rebuilt([t for _, _, t in out], 60) == "".join(pages)
    assert all(a <= b for a, b, _ in out)


def test_natural_boundaries():
    text = "First sentence here. Second one follows. " * 10
    assert all(u.endswith(". ") for u in splitting.units(text, 100))
    assert list(splitting.units("para one\n\npara two", 10)) == ["para one\n\n", "para two"]
    assert list(splitting.units("", 10)) == []


def test_batches_and_pieces(spark):
    rows = [
        (1, "a", 0, 0, 1, "ok", None, 10),
        (2, "a", 0, 3, 0, "ok", None, 20),
        (2, "a", 0, 3, 0, "ok", None, 20),
        (3, "a", 0, 9, 9, "error", None, 30),
        (4, "a", 0, None, 9, "ok", None, 40),
        (5, "a", 1, 4, 900_000_000, "ok", None, 5),
        (6, "b", 0, 0, 0, "failed", None, 5),
        (7, "c", 0, 0, 1, "ok", None, None),
    ]
    pages = [("a", 0, "x" * 3000), ("a", 1, None), ("a", 2, " " * 10), ("a", 3, "y. " * 2000), ("a", 4, "z" * 100), ("a", 3, "y. " * 2000), ("c", 0, "q" * 8000), ("c", 1, "")]
    table = spark.createDataFrame(pages, "pdf_path string, page_no int, page_text string").withColumn("batch_index", F.lit(77)).withColumn("n", F.lit("clash"))
    got = splitting.pieces(progress(spark, rows), table).orderBy("pdf_path", "batch_index", "piece_no").collect()
    assert {(r.pdf_path, r.batch_index) for r in got} == {("a", 0)}
    assert rebuilt([r.text for r in got], splitting.OVERLAP) == "x" * 3000 + " " * 10 + "y. " * 2000
    assert [r.piece_no for r in got] == list(range(len(got))) and got[0].start_page == 0 and got[-1].end_page == 3
    assert max(len(r.text) for r in got) <= splitting.LIMIT
    large = splitting.oversized(progress(spark, rows), table).collect()
    assert [(r.pdf_path, r.batch_index, r.n_chars) for r in large] == [("a", 0, 9010)]


def test_empty_tables(spark):
    pages = spark.createDataFrame([], "pdf_path string, page_no int, page_text string")
    assert splitting.pieces(progress(spark, []), pages).collect() == []


def test_bad_overlap():
    with pytest.raises(ValueError):
        splitting.Packer(10, 10)


def test_stray_page_numbers(spark):
    rows = [(1, "a", 0, 0, 2_000_000_000, "ok", None, 1), (2, "a", 1, 5000, 9100, "ok", None, 1), (3, "b", 0, -7, 0, "ok", None, 1)]
    pages = [("a", n, "x" * 900) for n in (0, 1, 4095, 4096, 5000, 9099, 9100, 9101, 2_000_000_000)] + [("b", -7, "y"), ("b", 0, "z")]
    table = spark.createDataFrame(pages, "pdf_path string, page_no int, page_text string")
    met = {(r.pdf_path, r.batch_index, r.page_no) for r in splitting.batch_pages(progress(spark, rows), table).collect()}
    there = {(p, n) for p, n, _ in pages}
    assert {m for m in met if (m[0], m[2]) in there} == {("a", 0, n) for p, n, _ in pages if p == "a"} | {("a", 1, n) for n in (5000, 9099, 9100)} | {("b", 0, -7), ("b", 0, 0)}
    assert [(r.batch_index, r.n_chars) for r in splitting.oversized(progress(spark, rows), table).collect()] == [(0, 8100)]
