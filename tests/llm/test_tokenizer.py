import base64
import random

import pytest
from pyspark.sql import Row

from sievemill.llm import tokenizer

TRICKY = ["", " ", "a", "  two  blanks ", "don't we'll", "Ünïcödé straße ﬁle Ⅷ", "שלום مرحبا १२३", "<|endoftext|> [INST]", "😀👩‍👩‍👧", "\n\n\t x\r\n", "12345 67,890.1", "中文没有空格的一句话", "\x00\x01", "a" * 500, "=" * 333, "﻿​x y"]


@pytest.fixture(scope="module")
def reference():
    tiktoken = pytest.importorskip("tiktoken")
    with open(tokenizer.VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=tokenizer.PRE_TOKEN, mergeable_ranks=ranks, special_tokens={})


def test_same_ids_as_the_public_library(reference):
    encode = tokenizer.encoder(tokenizer.VOCABULARY).encode
    rng = random.Random(5)
    texts = TRICKY + ["".join(rng.choice("abc deÄß.,1 \n") for _ in range(rng.randint(1, 300))) for _ in range(200)] + ["".join(rng.choice("abcdefgh") for _ in range(3000))]
    for text in texts:
        assert encode(text) == reference.encode_ordinary(text), repr(text)


def test_unbroken_text_is_not_quadratic(reference):
    import time

    text = "".join(random.Random(1).choice("abcdefgh") for _ in range(200_000))
    began = time.time()
    tokenizer.encoder(tokenizer.VOCABULARY).encode(text)
    assert time.time() - began < 20


def test_queue_pops_lowest_rank_and_empties():
    queue = tokenizer.RankQueue(50_256)
    for rank, at in ((4096, 1), (3, 2), (50_255, 3), (4096, 4), (64, 5)):
        queue.push(rank, at)
    assert [queue.pop() for _ in range(4)] == [(3, [2]), (64, [5]), (4096, [1, 4]), (50_255, [3])]
    assert queue.pop() is None and not queue.top and not any(queue.mid) and not any(queue.low)


def test_column_form_and_round_trip(spark):
    rows = [Row(doc_id=i, text=t, ids="clash") for i, t in enumerate([None, *TRICKY, TRICKY[4]])]
    made = tokenizer.decode(tokenizer.encode(spark.createDataFrame(rows), ["doc_id"]), "ids", "back").collect()
    assert {r.doc_id: r.back for r in made} == {i: (r.text or "") for i, r in enumerate(rows)}
    assert next(r for r in made if r.doc_id == 0).ids == []
    counts = tokenizer.count_tokens(spark.createDataFrame(rows), ["doc_id"]).collect()
    assert {r.doc_id: r.n_tokens for r in counts} == {r.doc_id: len(r.ids) for r in made}


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert tokenizer.encode(empty, ["doc_id"]).collect() == []
