"""Problem 2: near-duplicate texts by word-set Jaccard similarity, in a collection too large for pairwise comparison.

1. Sets. Each text is read once: its words are hashed in an Arrow batch and written as a table of (id, class, word
   hashes) in the shared folder, from which all later steps read the columns they need. Texts with the same set of words
   are one class (similarity 1), keyed by 128 bits; copies hang star-shaped on their class, so a group of copies costs as
   many rows as it has members, never their pairs.
2. Signatures. One-permutation hashing: one 64-bit hash per word, the top half picks one of bands x rows bins and each
   bin keeps its minimum; empty bins borrow from a hashed non-empty bin (optimal densification).
3. Buckets. Equal bands of a signature share a bucket. Buckets are sorted runs after one shuffle; inside a run members
   are compared by a parity sketch: bit i tells whether an odd number of the set's words falls on it, so two sketches
   differ in at most as many bits as the sets differ in words. Pairs whose sketches differ in more bits, or whose sizes
   differ by more, than similarity t allows are unlike for certain; the filter loses none.
4. Large runs. A run of more than `cap` members passes its members on as they stream by and emits no pairs. All such
   members go, once each, to sub-buckets by their rarest words: by the prefix-filter bound two sets of similarity t share
   a word among the first n - ceil(t n) + 1 of any common order, so sub-buckets lose no pair of the run.
5. Verification. Every candidate is confirmed by the exact Jaccard similarity of the two sets of 64-bit word hashes.

A star over each bucket alone would lose links between two leaves whose centre is unlike both; that is why runs are
compared in full up to the cap and stars are kept to copies. Only the bands can lose a pair: their recall at similarity
s is about 1 - (1 - s^rows)^bands, 0.9997 at 0.7 and above 0.9999 at 0.75 with 44 bands of 5 rows (0.9992 to 0.9997 at
0.7 when simulated with densified signatures of sets of 8 to 170 words).

Null texts have no words and, like texts under `min_words`, are in no class. Of repeated ids the delivery latest by
`order` counts. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievemill.llm.common import cut, latest, spread, stored

BANDS, ROWS = 44, 5
BUCKET_CAP = 4096
SKETCH_BITS = 112
#: Sizes are told up to here; larger sets go to verification unfiltered.
SIZE_TOLD = (1 << 14) - 1
#: A set of class ids this small (16 MB) is broadcast.
BROADCAST_IDS = 1_000_000
#: Bins of the word counts that order words in large runs; their counts come to the driver.
ORDER_BINS = 1 << 16
#: Candidates held by a task before they are passed on.
PAIRS_HELD = 1 << 20
#: Rows that one numpy step works on.
STEP = 2048
U = np.uint64


@dataclass
class NearDuplicates:
    classes: DataFrame  # class_id, side (bits of all its rows)
    members: DataFrame  # id, class_id, side
    links: DataFrame  # class_a, class_b, jaccard; each pair once


def _mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finalizer."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_IS_WORD = np.zeros(256, bool)
_IS_WORD[list(b"abcdefghijklmnopqrstuvwxyz0123456789")] = True


def word_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The distinct word hashes of each lower-cased text, one text after the other, and how many each has; null has none.

    A word is a maximal run of a-z and 0-9. All words of the batch are hashed at once: a polynomial of their bytes, summed
    per word, then mixed.
    """
    texts = texts.cast(pa.large_string())
    n = len(texts)
    _, at, data = texts.buffers()
    offsets = np.frombuffer(at, np.int64, n + 1, texts.offset * 8)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    inside = _IS_WORD[raw]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = offsets[:-1] - offsets[0]
    edges = edges[edges < len(raw)]
    begins[edges] = inside[edges]
    first = np.flatnonzero(begins)
    if not len(first):
        return np.zeros(0, U), np.zeros(n, np.int64)
    places = np.flatnonzero(inside)
    word_at = np.flatnonzero(begins[places])
    sizes = np.diff(np.r_[word_at, len(places)])
    within = places - np.repeat(first, sizes)
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.full(int(sizes.max()), 0x9E3779B97F4A7C15, U)) * U(0xC2B2AE3D27D4EB4F)
        hashes = _mix(_mix(np.add.reduceat((raw[places].astype(U) + U(1)) * powers[within], word_at)) + sizes.astype(U))
    row = np.searchsorted(offsets - offsets[0], first, "right") - 1
    order = np.lexsort((hashes, row))
    hashes, row = hashes[order], row[order]
    fresh = np.r_[True, (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])]
    return hashes[fresh], np.bincount(row[fresh], minlength=n)


def _starts(sizes: np.ndarray) -> np.ndarray:
    return np.r_[0, np.cumsum(sizes)[:-1]].astype(np.int64)


def set_keys(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """128-bit fingerprints of sets that hold at least one hash each, as two columns."""
    with np.errstate(over="ignore"):
        at = _starts(sizes)
        parts = [np.add.reduceat(_mix(values ^ U(salt)), at) + sizes.astype(U) for salt in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]
        return np.stack([_mix(p) for p in parts], axis=1)


def as_binary(rows: np.ndarray) -> pa.Array:
    """A binary value per row of a matrix of 64-bit numbers, big-endian."""
    n, width = rows.shape
    data = np.ascontiguousarray(rows.astype(">u8"))
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, (n + 1) * width * 8, width * 8, dtype=np.int32)), pa.py_buffer(data)])


def lists_as_binary(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """A binary value per list of 64-bit hashes; lists without values are null."""
    offsets = np.r_[0, np.cumsum(sizes)] * 8
    made = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(values))])
    return pc.if_else(pa.array(sizes > 0), made, None).cast(pa.binary())


def from_binary(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all values and their lengths; no value may be null."""
    column = column.cast(pa.large_binary())
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64, len(column) + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, np.diff(offsets)


def keys_of(column: pa.Array) -> np.ndarray:
    return np.frombuffer(from_binary(column)[0].tobytes(), ">u8").astype(U).reshape(-1, 2)


def hashes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    raw, sizes = from_binary(column)
    return np.frombuffer(raw.tobytes(), U), sizes // 8


def signatures(values: np.ndarray, sizes: np.ndarray, bins: int) -> np.ndarray:
    """Densified one-permutation signatures, a row per set; every set must hold at least one 64-bit hash."""
    n = len(sizes)
    with np.errstate(over="ignore"):
        owner = np.repeat(np.arange(n), sizes)
        mixed = _mix(values)
        slot = owner * bins + (((mixed >> U(32)) * U(bins)) >> U(32)).astype(np.int64)
        empty = U(0xFFFFFFFFFFFFFFFF)
        sig = np.full(n * bins, empty, U)
        np.minimum.at(sig, slot, _mix(mixed + U(0x9E3779B97F4A7C15)))
        sig = sig.reshape(n, bins)
        filled = sig != empty
        row, col = np.nonzero(~filled)
        attempt = 1
        while len(row):
            donors = ((_mix(np.arange(bins, dtype=U) + U(attempt << 20)) >> U(32)) * U(bins) >> U(32)).astype(np.int64)
            donor = donors[col]
            hit = filled[row, donor]
            sig[row[hit], col[hit]] = sig[row[hit], donor[hit]]
            row, col = row[~hit], col[~hit]
            attempt += 1
    return sig


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        parts = sig.reshape(len(sig), bands, rows)
        key = np.broadcast_to(np.arange(1, bands + 1, dtype=U), parts.shape[:2]).copy()
        for r in range(rows):
            key = _mix(key * U(0x9E3779B97F4A7C15) + parts[:, :, r])
    return key


def sketches(values: np.ndarray, sizes: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two numbers a set: 64 parity bits, then 48 parity bits | 14 bits of the set size | 2 bits of the side."""
    with np.errstate(over="ignore"):
        place = (_mix(values ^ U(0x8EBC6AF09C88C6E3)) >> U(32)) * U(SKETCH_BITS) >> U(32)
    at = _starts(sizes)
    low = np.bitwise_xor.reduceat(np.where(place < 64, U(1) << (place & U(63)), U(0)), at)
    high = np.bitwise_xor.reduceat(np.where(place >= 64, U(1) << (place & U(63)), U(0)), at)
    return low, high | (np.minimum(sizes, SIZE_TOLD).astype(U) << U(48)) | (side.astype(U) << U(62))


def _read_batches(min_words: int):
    """(id, at, side, text) to the rows of the table of sets; a text too short or without a side has no class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at in range(0, big.num_rows, STEP):
                batch = big.slice(at, STEP)
                values, sizes = word_sets(batch.column("text"))
                good = (sizes >= max(1, min_words)) & batch.column("side").is_valid().to_numpy(zero_copy_only=False)
                values, kept = values[np.repeat(good, sizes)], np.where(good, sizes, 0)
                key = np.full(len(sizes), None, object)
                if good.any():
                    key[good] = as_binary(set_keys(values, kept[good])).to_pylist()
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("at"), batch.column("side"), pa.array(key, pa.binary()), lists_as_binary(values, kept)], names=["id", "at", "side", "class_id", "hashes"])

    return run


BUCKET = "key long, c1 long, c2 long, low long, high long"


def _distinct_classes(big: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Keys, sides (bits of all copies) and hashes of the classes of a batch, once each, so hot copies leave few rows."""
    keys = keys_of(big.column("class_id"))
    order = np.lexsort((keys[:, 1], keys[:, 0]))
    first = np.flatnonzero(np.r_[True, (keys[order][1:] != keys[order][:-1]).any(axis=1)])
    sides = np.bitwise_or.reduceat(big.column("side").to_numpy(zero_copy_only=False).astype(np.int64)[order], first)
    return keys[order[first]], sides, big.column("hashes").take(pa.array(order[first]))


def _signature_batches(bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            if not big.num_rows:
                continue
            keys, sides, hashes = _distinct_classes(big)
            for at in range(0, len(keys), STEP):
                values, sizes = hashes_of(hashes.slice(at, STEP))
                sig = signatures(values, sizes, bands * rows)
                found = band_keys(sig, bands, rows)
                low, high = sketches(values, sizes, sides[at : at + STEP])
                columns = [found.reshape(-1), *(np.repeat(c, bands) for c in (*keys[at : at + STEP].T, low, high))]
                yield pa.RecordBatch.from_arrays([pa.array(c.view(np.int64)) for c in columns], names=["key", "c1", "c2", "low", "high"])

    return run


def _pair_batches(threshold: float, cap: int | None, cross: bool):
    """(key, c1, c2, low, high) rows sorted by key to candidate pairs (a, b) and members of large runs (a, null)."""
    differ = (1 - threshold) / (1 + threshold)

    def likely(r: dict, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        na, nb = ((r["high"][x] >> U(48)) & U(SIZE_TOLD) for x in (i, j))
        na, nb = na.astype(np.int64), nb.astype(np.int64)
        told = np.maximum(na, nb) < SIZE_TOLD
        odd = r["high"][i] ^ r["high"][j]
        unlike = np.bitwise_count(r["low"][i] ^ r["low"][j]).astype(np.int64) + np.bitwise_count(odd & U((1 << 48) - 1))
        keep = ~told | ((unlike <= differ * (na + nb) + 1e-9) & (np.minimum(na, nb) >= threshold * np.maximum(na, nb) - 1e-9))
        if cross:
            sa, sb = r["high"][i] >> U(62), r["high"][j] >> U(62)
            keep &= ((sa & U(1) > 0) & (sb & U(2) > 0)) | ((sa & U(2) > 0) & (sb & U(1) > 0))
        return keep

    def live(r: dict) -> dict:
        """Rows of runs with at least two different classes; a class that was signed in several batches becomes one, with all its sides."""
        k = r["key"]
        if not len(k):
            return r
        same = k[1:] == k[:-1]
        keep = np.r_[False, same] | np.r_[same, False]
        r = {c: v[keep] for c, v in r.items()}
        order = np.lexsort((r["c2"], r["c1"], r["key"]))
        r = {c: v[order] for c, v in r.items()}
        if not len(order):
            return r
        first = np.flatnonzero(np.r_[True, (r["key"][1:] != r["key"][:-1]) | (r["c1"][1:] != r["c1"][:-1]) | (r["c2"][1:] != r["c2"][:-1])])
        return {c: np.bitwise_or.reduceat(v, first) if c == "high" else v[first] for c, v in r.items()}

    def runs(r: dict) -> Iterator[np.ndarray]:
        r = live(r)
        key = r["key"]
        own = np.stack([r["c1"], r["c2"]], axis=1)
        at = np.arange(len(key))
        step = 1
        while True:  # compare each member with the one `step` places on, while that is in the same run
            at = at[at + step < len(key)]
            at = at[key[at] == key[at + step]]
            if not len(at):
                return
            good = at[likely(r, at, at + step)]
            if len(good):
                yield np.hstack([own[good], own[good + step]])  # sorted, so the first is the lesser
            step += 1

    def distinct(held: list) -> pa.RecordBatch:
        p = np.concatenate(held)
        p = p[np.lexsort(p.T[::-1])]
        p = p[np.r_[True, (p[1:] != p[:-1]).any(axis=1)]]
        return pa.RecordBatch.from_arrays([as_binary(p[:, :2]), as_binary(p[:, 2:])], names=["a", "b"])

    def members(parts: list[dict]) -> Iterator[pa.RecordBatch]:
        for r in parts:
            yield pa.RecordBatch.from_arrays([as_binary(np.stack([r["c1"], r["c2"]], axis=1)), pa.nulls(len(r["c1"]), pa.binary())], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[dict] = []  # the rows of the last key so far
        n_rest, large, last_key = 0, False, None
        held: list = []
        n_held = 0

        def pairs(r: dict) -> Iterator[pa.RecordBatch]:
            nonlocal held, n_held
            for p in runs(r):
                held.append(p)
                n_held += len(p)
                if n_held >= PAIRS_HELD:
                    yield distinct(held)
                    held, n_held = [], 0

        def finish() -> Iterator[pa.RecordBatch]:
            if rest and large:
                yield from members(rest)
            elif rest:
                yield from pairs({c: np.concatenate([x[c] for x in rest]) for c in rest[0]})

        for batch in batches:
            if not batch.num_rows:
                continue
            r = {c: batch.column(c).to_numpy().view(U) for c in ("key", "c1", "c2", "low", "high")}
            edge = np.flatnonzero(np.r_[True, r["key"][1:] != r["key"][:-1]])
            length = np.diff(np.r_[edge, len(r["key"])])
            if r["key"][0] == last_key:  # the open run goes on
                head = {c: v[: length[0]] for c, v in r.items()}
                if large:
                    yield from members([head])
                else:
                    rest.append(head)
                    n_rest += int(length[0])
                    if cap is not None and n_rest > cap:
                        yield from members(rest)
                        rest, large = [], True
                if len(edge) == 1:
                    continue
                edge, length = edge[1:], length[1:]
            yield from finish()
            begin, end = int(edge[0]), int(edge[-1])
            if cap is not None and (length[:-1] > cap).any():
                big = np.repeat(length[:-1] > cap, length[:-1])
                whole = {c: v[begin:end] for c, v in r.items()}
                yield from members([{c: v[big] for c, v in whole.items()}])
                yield from pairs({c: v[~big] for c, v in whole.items()})
            else:
                yield from pairs({c: v[begin:end] for c, v in r.items()})
            rest, n_rest, last_key = [{c: v[end:].copy() for c, v in r.items()}], int(length[-1]), r["key"][-1]
            large = cap is not None and n_rest > cap
            if large:
                yield from members(rest)
                rest = []
        yield from finish()
        if held:
            yield distinct(held)

    return run


def _pairs(bucketed: DataFrame, threshold: float, cap: int | None, cross: bool) -> DataFrame:
    return bucketed.repartition("key").sortWithinPartitions("key").mapInArrow(_pair_batches(threshold, cap, cross), "a binary, b binary")


def _bin_of(values: np.ndarray) -> np.ndarray:
    return (values >> U(48)).astype(np.int64) % ORDER_BINS


def _count_bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(ORDER_BINS, np.int64)
    for batch in batches:
        if batch.num_rows:
            total += np.bincount(_bin_of(hashes_of(batch.column("hashes"))[0]), minlength=ORDER_BINS)
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["bin", "n"])


def _prefix_batches(threshold: float, often: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at in range(0, big.num_rows, STEP):
                batch = big.slice(at, STEP)
                keys = keys_of(batch.column("class_id"))
                values, sizes = hashes_of(batch.column("hashes"))
                low, high = sketches(values, sizes, batch.column("side").to_numpy(zero_copy_only=False).astype(np.int64))
                owner = np.repeat(np.arange(len(sizes)), sizes)
                order = np.lexsort((values, often[_bin_of(values)], owner))
                place = np.arange(len(values)) - np.repeat(_starts(sizes), sizes)
                first = place < np.repeat(sizes - np.ceil(threshold * sizes - 1e-9).astype(np.int64) + 1, sizes)
                word, who = values[order][first], owner[first]
                yield pa.RecordBatch.from_arrays([pa.array(c.view(np.int64)) for c in (word, keys[who, 0], keys[who, 1], low[who], high[who])], names=["key", "c1", "c2", "low", "high"])

    return run


def _refined(held: DataFrame, threshold: float) -> DataFrame:
    """All members of over-full buckets, once each (class_id, side, hashes), under sub-buckets by their rare words.

    The order is the count of the word's bin among these members, then its hash: the same for all of them, which is what
    the prefix bound asks for. Two of them that are alike share one of their first words, so it does not matter in which
    buckets they met.
    """
    often = np.zeros(ORDER_BINS, np.int64)
    for r in held.select("hashes").mapInArrow(_count_bins, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect():  # at most ORDER_BINS rows
        often[r["bin"]] = r["n"]
    return held.mapInArrow(_prefix_batches(threshold, often), BUCKET)


def word_table(df: DataFrame, ident: str, text: Column, *, min_words: int, order: str | None, side: Column | None) -> DataFrame:
    """id, at, side, class_id, hashes of every row with an id, written once; class_id and hashes are null outside all classes."""
    at = F.col(order) if order else F.lit(None).cast("timestamp_ntz")
    plain = spread(df.select(F.col(ident).alias("id"), at.alias("at"), (side if side is not None else F.lit(1)).cast("int").alias("side"), F.lower(text).alias("text")).where("id IS NOT NULL"))
    kinds = {c: plain.schema[c].dataType.simpleString() for c in ("id", "at")}
    return stored(plain.mapInArrow(_read_batches(min_words), f"id {kinds['id']}, at {kinds['at']}, side int, class_id binary, hashes binary"))


def find(
    df: DataFrame, ident: str, text: Column, *, threshold: float = 0.7, min_words: int = 1, order: str | None = None, side: Column | None = None, bands: int = BANDS, rows: int = ROWS, cap: int = BUCKET_CAP
) -> NearDuplicates:
    """Classes, members and all links of at least `threshold` between classes.

    `side` (1 or 2, null takes no part) restricts links to pairs with one member on each side.
    """
    cross = side is not None
    known = word_table(df, ident, text, min_words=min_words, order=order, side=side)
    # The latest delivery decides; it may be too short, which its null class_id says.
    members = latest(known.select("id", "at", "side", "class_id"), ["id"], ["at"], ["side", "class_id"]).where("class_id IS NOT NULL")
    in_class = known.where("class_id IS NOT NULL").select("class_id", "side", "hashes")
    bucketed = in_class.mapInArrow(_signature_batches(bands, rows), BUCKET)
    found = cut(_pairs(bucketed, threshold, cap, cross).dropDuplicates())
    large = found.where("b IS NULL").select(F.col("a").alias("class_id"))
    pairs = found.where("b IS NOT NULL")
    if not large.isEmpty():
        more = _pairs(_refined(_wanted(in_class, large), threshold), threshold, None, cross)
        pairs = cut(pairs.unionByName(more).dropDuplicates())
    ends = pairs.select(F.col("a").alias("class_id")).unionByName(pairs.select(F.col("b").alias("class_id")))
    links = verify(pairs, _wanted(in_class, ends), threshold)
    return NearDuplicates(in_class.groupBy("class_id").agg(F.bit_or("side").alias("side")), members, links)


def _wanted(in_class: DataFrame, ids: DataFrame) -> DataFrame:
    """One row with its hashes and all its sides for each class named in `ids`.

    The ids are counted first: up to BROADCAST_IDS they filter the scan as a broadcast, so other sets are not moved;
    beyond that the join shuffles both sides by class.
    """
    ids = ids.distinct()
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    kept = in_class.join(F.broadcast(ids) if few else ids, "class_id", "left_semi")
    return kept.groupBy("class_id").agg(F.first("hashes").alias("hashes"), F.bit_or("side").alias("side"))


def _verify_batches(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at in range(0, big.num_rows, STEP):
                batch = big.slice(at, STEP)
                (va, na), (vb, nb) = (hashes_of(batch.column(c)) for c in ("hashes_a", "hashes_b"))
                pair = np.arange(len(na))
                owner, values = np.r_[np.repeat(pair, na), np.repeat(pair, nb)], np.r_[va, vb]
                order = np.lexsort((values, owner))
                owner, values = owner[order], values[order]
                both = (owner[1:] == owner[:-1]) & (values[1:] == values[:-1])
                shared = np.bincount(owner[1:][both], minlength=len(pair))
                jaccard = shared / (na + nb - shared)
                good = pa.array(np.flatnonzero(jaccard >= threshold - 1e-12))
                yield pa.RecordBatch.from_arrays([batch.column("a").take(good), batch.column("b").take(good), pa.array(jaccard).take(good)], names=["class_a", "class_b", "jaccard"])

    return run


def verify(pairs: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """Exact Jaccard similarity of candidate pairs; those below the threshold go."""
    side_a = classes.select(F.col("class_id").alias("a"), F.col("hashes").alias("hashes_a"))
    side_b = classes.select(F.col("class_id").alias("b"), F.col("hashes").alias("hashes_b"))
    both = pairs.join(side_a, "a").join(side_b, "b").select("a", "b", "hashes_a", "hashes_b")
    return both.mapInArrow(_verify_batches(threshold), "class_a binary, class_b binary, jaccard double")


def id_pairs(found: NearDuplicates, a: str, b: str) -> DataFrame:
    """All pairs of different ids whose texts are alike, smaller id first: linked classes and copies of one class."""
    left = found.members.select(F.col("class_id").alias("class_a"), F.col("id").alias("x"), F.col("side").alias("sx"))
    right = found.members.select(F.col("class_id").alias("class_b"), F.col("id").alias("y"), F.col("side").alias("sy"))
    linked = found.links.join(left, "class_a").join(right, "class_b").select("x", "y", "sx", "sy", "jaccard")
    copies = left.join(right, F.col("class_a") == F.col("class_b")).where("x < y").select("x", "y", "sx", "sy", F.lit(1.0).alias("jaccard"))
    return linked.unionByName(copies).select(F.least("x", "y").alias(a), F.greatest("x", "y").alias(b), "sx", "sy", "jaccard")


def counts(found: NearDuplicates) -> DataFrame:
    """One row per id: its class, the least id of the class, how many ids share it and how many other ids it is linked to in all."""
    size = found.members.groupBy("class_id").agg(F.count("*").alias("copies"), F.min("id").alias("first_id"))
    ends = found.links.select(F.col("class_a").alias("class_id"), F.col("class_b").alias("other")).unionByName(found.links.select(F.col("class_b").alias("class_id"), F.col("class_a").alias("other")))
    degree = ends.join(size.select(F.col("class_id").alias("other"), F.col("copies").alias("weight")), "other").groupBy("class_id").agg(F.sum("weight").alias("linked"))
    per_class = size.join(degree, "class_id", "left").select("class_id", "first_id", "copies", (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"))
    return found.members.select("id", "class_id").join(per_class, "class_id").select("id", "class_id", "first_id", "copies", "n_links")


def id_groups(found: NearDuplicates) -> DataFrame:
    """One row per id: the least id of all that it hangs together with through links."""
    joined = found.members.select("id", "class_id").join(groups(found.links), "class_id", "left").select("id", F.coalesce("group_id", "class_id").alias("group"))
    return joined.join(joined.groupBy("group").agg(F.min("id").alias("group_id")), "group").select("id", "group_id")


def groups(links: DataFrame, rounds: int | None = None) -> DataFrame:
    """Connected components of (class_a, class_b): class_id, group_id (the least class id), for classes with a link.

    Alternates large-star and small-star steps until the edges are stars; each round is a few aggregations by node whose
    output is no larger than its input, and ends in a checkpoint.
    """
    edges = cut(links.select(F.col("class_a").alias("u"), F.col("class_b").alias("v")).where("u <> v").distinct())
    turn = 0
    while rounds is None or turn < rounds:
        # large-star: neighbours above a node move to the least node around it
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small-star: a node and its smaller neighbours move to the least of them
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        new = cut(small)
        same = new.exceptAll(edges).isEmpty() and edges.exceptAll(new).isEmpty()
        edges = new
        turn += 1
        if same:
            break
    roots = edges.select(F.col("v").alias("class_id"), F.col("v").alias("group_id")).distinct()
    return edges.select(F.col("u").alias("class_id"), F.col("v").alias("group_id")).unionByName(roots)
