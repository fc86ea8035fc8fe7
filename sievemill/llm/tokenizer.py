"""Problem 6: encode texts with a byte-level BPE vocabulary given as a rank file.

Merging uses a hierarchical-bitmap rank queue. Every merge rank owns a bucket of linked-list positions; a three-level
bitmap marks the ranks whose bucket is not empty, so the next rank is three find-first-set steps away. An entry whose
pair has changed since it was queued is stale and skipped. A pre-token of n bytes costs O(n) queue steps however long
it is, unlike the rescan of all pairs that is quadratic on unbroken texts. Pre-tokens repeat a lot, so each Python
worker keeps a bounded memo of short ones; it only saves time and never changes a result.

Null and empty texts give an empty list. Texts that look like special tokens are ordinary text.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievemill.llm.common import spread

#: Fixed value: the public pattern that splits text before the merges of the rank files.
PRE_TOKEN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
MEMO_TOKENS = 400_000
MEMO_CHARS = 24
CHUNK_ROWS = 512


class RankQueue:
    """Min-queue of merge ranks: 64-way bitmaps over buckets of list positions."""

    __slots__ = ("buckets", "mid", "low", "top")

    def __init__(self, ranks: int) -> None:
        self.low = [0] * ((ranks >> 6) + 1)
        self.mid = [0] * ((ranks >> 12) + 1)
        self.top = 0
        self.buckets: dict[int, list[int]] = {}

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            bucket.append(position)
            return
        self.buckets[rank] = [position]
        self.low[rank >> 6] |= 1 << (rank & 63)
        self.mid[rank >> 12] |= 1 << (rank >> 6 & 63)
        self.top |= 1 << (rank >> 12)

    def pop(self) -> tuple[int, list[int]] | None:
        """The lowest rank with its positions, which leave the queue."""
        top = self.top
        if not top:
            return None
        a = (top & -top).bit_length() - 1
        word = self.mid[a]
        b = a << 6 | (word & -word).bit_length() - 1
        word = self.low[b]
        rank = b << 6 | (word & -word).bit_length() - 1
        self.low[b] &= word - 1
        if not self.low[b]:
            self.mid[a] &= self.mid[a] - 1
            if not self.mid[a]:
                self.top &= top - 1
        return rank, self.buckets.pop(rank)


class Encoder:
    def __init__(self, vocabulary: str) -> None:
        with open(vocabulary, "rb") as lines:
            pairs = [line.split() for line in lines if line.strip()]
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
        self.bytes_of = {rank: token for token, rank in self.ranks.items()}
        self.single = [self.ranks[bytes([b])] for b in range(256)]
        self.queue = RankQueue(max(self.bytes_of) + 1)
        self.pair_rank: dict[tuple[int, int], int] = {}
        self.memo: dict[str, list[int]] = {}
        self.split = regex.compile(PRE_TOKEN).findall

    def rank_of(self, left: int, right: int) -> int:
        """Rank of the merged pair, or -1."""
        found = self.pair_rank.get((left, right))
        if found is None:
            found = self.ranks.get(self.bytes_of[left] + self.bytes_of[right], -1)
            if len(self.pair_rank) > 2_000_000:
                self.pair_rank.clear()
            self.pair_rank[left, right] = found
        return found

    def merge(self, data: bytes) -> list[int]:
        """Ids of one pre-token: always the lowest rank, leftmost first."""
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        n = len(data)
        ids = [self.single[b] for b in data]
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        rank_at = [self.rank_of(ids[i], ids[i + 1]) for i in range(n - 1)] + [-1]
        queue = self.queue
        for i, rank in enumerate(rank_at):
            if rank >= 0:
                queue.push(rank, i)
        while (entry := queue.pop()) is not None:
            rank, positions = entry
            positions.sort()
            for k, i in enumerate(positions):
                if rank_at[i] != rank:  # stale: the pair at i was merged or changed
                    continue
                j = after[i]
                ids[i], rank_at[j] = rank, -1
                after[i] = nxt = after[j]
                lower = False
                if nxt < n:
                    before[nxt] = i
                    rank_at[i] = new = self.rank_of(rank, ids[nxt])
                    if new >= 0:
                        queue.push(new, i)
                        lower = new < rank
                else:
                    rank_at[i] = -1
                if (prev := before[i]) >= 0:
                    rank_at[prev] = new = self.rank_of(ids[prev], rank)
                    if new >= 0:
                        queue.push(new, prev)
                        lower = lower or new < rank
                if lower:  # a better pair appeared: put the rest of this bucket back
                    for p in positions[k + 1 :]:
                        queue.push(rank, p)
                    break
        out, i = [], 0
        while i < n:
            out.append(ids[i])
            i = after[i]
        return out

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        if not text:
            return out
        memo = self.memo
        for piece in self.split(text):
            ids = memo.get(piece)
            if ids is None:
                ids = self.merge(piece.encode("utf-8", "replace"))
                if len(piece) <= MEMO_CHARS:
                    if len(memo) >= MEMO_TOKENS:
                        memo.clear()
                    memo[piece] = ids
            out += ids
        return out


@lru_cache(maxsize=4)
def encoder(vocabulary: str) -> Encoder:
    """One encoder per Python worker and vocabulary."""
    return Encoder(vocabulary)


def _encode_batches(vocabulary: str, keep: list[str], text: str, out: str, count_only: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode
        for big in batches:
            for at in range(0, big.num_rows, CHUNK_ROWS):
                batch = big.slice(at, CHUNK_ROWS)
                columns = [batch.column(c) for c in keep]
                lists = [encode(x) for x in batch.column(text).to_pylist()]
                sizes = np.fromiter(map(len, lists), np.int64, len(lists))
                if count_only:
                    made = pa.array(sizes)
                else:
                    offsets = np.zeros(len(lists) + 1, np.int32)
                    np.cumsum(sizes, out=offsets[1:])
                    flat = np.fromiter((i for ids in lists for i in ids), np.int32, int(offsets[-1]))
                    made = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
                yield pa.RecordBatch.from_arrays([*columns, made], names=[*keep, out])

    return run


def _apply(df: DataFrame, key: list[str], text: str, out: str, kind: T.DataType, vocabulary: str, count_only: bool) -> DataFrame:
    fields = [df.schema[c] for c in key] + [T.StructField(out, kind)]
    run = _encode_batches(vocabulary, key, text, out, count_only)
    return spread(df.select(*key, text)).mapInArrow(run, T.StructType(fields))


def encode(df: DataFrame, key: list[str], text: str = "text", out: str = "ids", vocabulary: str = VOCABULARY) -> DataFrame:
    """`key` columns and the token ids of `text` as `out array<int>`, one row per input row, row by row.

    `key` may not hold `text` or `out`; other columns of `df` are ignored, so clashing names cannot reach the result.
    """
    return _apply(df, key, text, out, T.ArrayType(T.IntegerType()), vocabulary, False)


def count_tokens(df: DataFrame, key: list[str], text: str = "text", out: str = "n_tokens", vocabulary: str = VOCABULARY) -> DataFrame:
    """`key` columns and the number of tokens of `text` as `out bigint`; null and empty texts count 0."""
    return _apply(df, key, text, out, T.LongType(), vocabulary, True)


def decode(df: DataFrame, ids: str, out: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """Adds `out`, the text of the id list; bytes that are not UTF-8 become U+FFFD, null gives an empty text."""

    @F.pandas_udf(T.StringType())
    def back(lists):
        table = encoder(vocabulary).bytes_of
        return lists.map(lambda x: b"".join(table[int(i)] for i in (x if x is not None else [])).decode("utf-8", "replace"))

    return df.withColumn(out, back(F.col(ids)))
