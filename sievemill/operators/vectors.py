"""Exact vector top-k.

A bounded side goes to the executors as one numpy matrix, after its rows have been counted; the other side streams through
`mapInArrow`, a matrix product per batch. If the items are bounded, each query finishes where it is and nothing is
shuffled. Otherwise the queries are taken in bounded blocks, one after the other: a block's matrix is collected, every
partition of the items keeps k rows per query, those partial results, not the items, are shuffled, and the block's result
is written to the shared folder before the next block is collected. The driver never holds more than one block.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievemill.operators.state import stored

#: Vectors of the side that is sent to every executor (at 768 values of 8 bytes: 123 MB).
BLOCK_ROWS = 20_000
#: Scores that a worker holds at a time (8 bytes each).
SCORES_HELD = 4_000_000


def dimension(*sides: tuple[DataFrame, str]) -> int:
    """The most common vector length over all inputs, the greater of equally common ones; 0 without any vector."""
    sizes = reduce(DataFrame.unionByName, [df.select(F.size(v).alias("d")) for df, v in sides])
    best = sizes.where("d > 0").groupBy("d").agg(F.count("*").alias("n")).agg(F.max(F.struct("n", "d")).alias("m")).first()
    return best.m.d if best.m else 0


def _matrix(column, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors (float64) and the places of the rows that have one of the right length, without a value that is no number."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not pa.types.is_large_list(lists.type):
        lists = lists.cast(pa.large_list(lists.type.value_type))
    sizes = np.diff(lists.offsets.to_numpy())
    right = (sizes == dim) & lists.is_valid().to_numpy(zero_copy_only=False)
    whole = lists.filter(pa.array(right))
    flat = whole.flatten()
    made = flat.cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dim) if dim and len(whole) else np.zeros((0, dim))
    fine = np.isfinite(made).all(axis=1)
    good = np.flatnonzero(right)[fine]
    made = made[fine]
    norm = np.linalg.norm(made, axis=1, keepdims=True)
    return np.divide(made, norm, out=np.zeros_like(made), where=norm > 0), good


def _collect(df: DataFrame, key: str, vector: str, dim: int) -> tuple[np.ndarray, np.ndarray]:
    table = df.select(key, vector).toArrow()
    unit, good = _matrix(table.column(vector), dim)
    return table.column(key).to_numpy()[good], unit


def top_k(queries: DataFrame, items: DataFrame, k: int, *, query_key: str, item_key: str, query_vector: str, item_vector: str, dim: int | None = None, skip_self: bool = False, block: int = BLOCK_ROWS) -> DataFrame:
    """query_key, item_key, similarity, rank of the k most similar items of every query, by cosine, ties by item key.

    A null vector, one with another length than `dim` (by default the most common one of both inputs) or with a value that
    is no number takes no part; a zero vector has similarity 0 to all. Keys must be numbers. With `skip_self` an item of
    the same key is left out.
    """
    dim = dim or dimension((queries, query_vector), (items, item_vector))
    kinds = f"query_id {queries.schema[query_key].dataType.simpleString()}, item_id {items.schema[item_key].dataType.simpleString()}, similarity double"
    few_items = items.limit(block + 1).count() <= block
    if few_items:
        found = _against(queries, query_key, query_vector, *_collect(items, item_key, item_vector, dim), k, kinds, skip_self)
    else:
        blocks = max(1, -(-queries.count() // block))
        parts = queries.withColumn("_block", F.pmod(F.xxhash64(query_key), F.lit(blocks)))
        made = []
        for b in range(blocks):
            ids, unit = _collect(parts.where(F.col("_block") == b), query_key, query_vector, dim)
            made.append(stored(_best(_scan(items, item_key, item_vector, ids, unit, k, kinds, skip_self), k)))
        return _named(reduce(DataFrame.unionByName, made), query_key, item_key)
    return _named(_best(found, k), query_key, item_key)


def _best(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "item_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def _named(ranked: DataFrame, query_key: str, item_key: str) -> DataFrame:
    return ranked.select(F.col("query_id").alias(query_key if query_key != item_key else "query_id"), F.col("item_id").alias(item_key if query_key != item_key else "item_id"), "similarity", "rank")


def _emit(queries, items, scores) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(queries), pa.array(items), pa.array(scores)], names=["query_id", "item_id", "similarity"])


def _top(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, id and score of the k best of each row of finite scores, ties by id; a partial selection, then a sort of few."""
    n = scores.shape[1]
    if n > k:
        cut = np.partition(scores, n - k, axis=1)[:, n - k, None]
        row, col = np.nonzero((scores >= cut) & (scores > -np.inf))
    else:
        row, col = np.nonzero(scores > -np.inf)
    s, i = scores[row, col], ids[col]
    order = np.lexsort((i, -s, row))
    row, s, i = row[order], s[order], i[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    keep = place < k
    return row[keep], i[keep], s[keep]


def _against(queries: DataFrame, key: str, vector: str, ids: np.ndarray, unit: np.ndarray, k: int, kinds: str, skip_self: bool) -> DataFrame:
    """Each query against all items, which are few."""
    dim = unit.shape[1]
    step = max(1, SCORES_HELD // max(1, len(ids)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at in range(0, big.num_rows, step):
                batch = big.slice(at, step)
                own, good = _matrix(batch.column(vector), dim)
                names = batch.column(key).to_numpy(zero_copy_only=False)[good]
                if not len(names) or not len(ids):
                    continue
                scores = own @ unit.T
                if skip_self:
                    scores[names[:, None] == ids[None, :]] = -np.inf
                row, item, score = _top(scores, ids, k)
                yield _emit(names[row], item, score)

    return queries.select(key, vector).mapInArrow(run, kinds)


def _scan(items: DataFrame, key: str, vector: str, query_ids: np.ndarray, unit: np.ndarray, k: int, kinds: str, skip_self: bool) -> DataFrame:
    """A block of queries against a partition of the items: k rows a query are kept from batch to batch."""
    dim = unit.shape[1]
    width = max(k, SCORES_HELD // max(1, len(query_ids)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        for big in batches:
            for at in range(0, big.num_rows, width):
                batch = big.slice(at, width)
                own, good = _matrix(batch.column(vector), dim)
                names = batch.column(key).to_numpy(zero_copy_only=False)[good]
                if not len(names) or not len(query_ids):
                    continue
                scores = unit @ own.T
                if skip_self:
                    scores[query_ids[:, None] == names[None, :]] = -np.inf
                row, item, score = (np.concatenate(x) for x in zip(kept, _top(scores, names, k), strict=True))
                order = np.lexsort((item, -score, row))
                row, item, score = row[order], item[order], score[order]
                first = np.arange(len(row)) - np.searchsorted(row, row) < k
                kept = (row[first], item[first], score[first])
        if len(kept[0]):
            yield _emit(query_ids[kept[0]], kept[1], kept[2])

    return items.select(key, vector).mapInArrow(run, kinds)


def cosine(a: str, b: str):
    """Cosine of two array columns inside the JVM; 0 where a vector is zero."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    size = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.coalesce(dot / F.nullif(size(a) * size(b), F.lit(0.0)), F.lit(0.0))


def sized(vector: str, dim: int):
    """The vector, or an error where its length is wrong."""
    return F.when(F.size(vector) == dim, F.col(vector)).otherwise(F.raise_error(F.concat(F.lit(f"expected {dim} values, got "), F.size(vector).cast("string"))))
