"""Problem 7: combine sources to target shares of the total size in tokens.

Every source is cut into `BLOCKS` pseudo-random blocks by a hash of the document id, so block totals are one map-side
combined aggregation whose result is at most (sources x blocks) rows, whatever the corpus size. From those totals the
driver fixes each source's quota, the number of whole passes over it and the block in which the last pass stops. The
block uses (block, pass) are then dealt to output shards down a binary tree: at each node a multivariate hypergeometric
draw splits the exact per-source counts between the two halves. A shard takes the next block uses of each source's
permuted list, so shards are disjoint; it is one partition, whose rows are ordered by a hash (local shuffle).

Uses are bounded by `MAX_USES` whatever the repeats: a source used very often joins neighbouring blocks, and at last whole
runs of passes, to one use. The block that the last pass stops in is cut once more into `BLOCKS` parts, so only one part
of one block of a source (a millionth of it) is ordered document by document.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievemill.llm.common import cut, latest
from sievemill.llm.tokenizer import VOCABULARY, count_tokens

BLOCKS = 1024
#: Shards are at least this many, and more where they would hold over TOKENS_PER_SHARD.
LEAST_SHARDS = 32
TOKENS_PER_SHARD = 64_000_000
#: More sources than this in the weights table is an error: block totals of all of them come to the driver.
MAX_SOURCES = 2000
#: Block uses in the table that tells each block its shards, shared evenly among the sources.
MAX_USES = 500_000


@dataclass
class Mix:
    sample: DataFrame  # doc_id, source, copy_no, shard, shuffle_key, n_tokens
    report: DataFrame  # a row per weighted source


def sizes(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, source (trimmed, lower case), n_tokens; one row per doc_id, the latest `fetched_at` delivery.

    Null texts count 0 tokens; rows with a null doc_id are dropped. Texts are counted before the shuffle, so only ids
    and numbers move.
    """
    counted = count_tokens(documents, ["doc_id", "source", "fetched_at"], "text", "n_tokens", vocabulary)
    return latest(counted, ["doc_id"], ["fetched_at"], ["source", "n_tokens"]).select("doc_id", F.lower(F.trim("source")).alias("source"), "n_tokens")


def _block(seed: int):
    return F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(BLOCKS)).cast("int")


def _totals(sized: DataFrame, block) -> DataFrame:
    return sized.withColumn("block", block).groupBy("source", "block").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs"))


def uses_of(totals: dict[int, tuple[int, int]], order: np.ndarray, passes: int, rest: int, room: int) -> tuple[list[tuple[int, int, int]], int, tuple[int, int] | None]:
    """Block uses (block, first copy, copies) of a source, how many blocks of BLOCKS one of them is wide, and the use that
    is taken in part (block, tokens still wanted), which is the last of the list.

    `totals` holds tokens and documents per block; the passes are whole, and `rest` tokens are due beyond them.
    """
    width = 1
    while width < BLOCKS and (passes + 1) * (BLOCKS // width) > room:
        width *= 2
    wide: dict[int, tuple[int, int]] = {}
    for b, (tokens, docs) in totals.items():
        t, n = wide.get(b // width, (0, 0))
        wide[b // width] = (t + tokens, n + docs)
    walk = [b for b in dict.fromkeys(int(b) // width for b in order) if b in wide]
    run = -(-passes // room) if width == BLOCKS and passes > room else 1
    mine = [(b, p, min(run, passes - p)) for p in range(0, passes, run) for b in walk]
    for b in walk:
        tokens, docs = wide[b]
        if not rest or not tokens:
            continue
        if tokens <= rest:
            mine.append((b, passes, 1))
            rest -= tokens
        elif docs > 1:
            return [*mine, (b, passes, 1)], width, (b, rest)
    return mine, width, None


def _deal(rng: np.random.Generator, counts: np.ndarray, first: int, shards: int, out: dict[int, np.ndarray]) -> None:
    """Splits per-source block counts over `shards` shards from `first` on."""
    if shards == 1:
        out[first] = counts
        return
    left = shards // 2
    n = int(round(counts.sum() * left / shards))
    share = rng.multivariate_hypergeometric(counts, n, method="marginals") if n else np.zeros_like(counts)
    _deal(rng, share, first, left, out)
    _deal(rng, counts - share, first + left, shards - left, out)


def mix(documents: DataFrame, weights: DataFrame, *, total_tokens: int | None = None, shards: int | None = None, seed: int = 7, vocabulary: str = VOCABULARY) -> Mix:
    """Sample of `documents` whose sources hold their `target_share` of `total_tokens` (default: all tokens).

    A source is used whole floor(quota / its tokens) times and once more up to the rest of its quota, never more than
    `max_repeats` times per document; the rest is met to within one document. Documents of sources that `weights` does
    not list only count towards the total. Repeated weight rows count once; null shares or repeats count as 0.

    The report is made from the sample: a source is not `reachable` when all its documents were used as often as they
    may be and the tokens drawn are still below its share; a source without documents and with a share is such a one.
    With an empty corpus no share can be missed.
    """
    spark = documents.sparkSession
    sized = cut(sizes(documents, vocabulary))
    wanted = weights.groupBy(F.lower(F.trim("source")).alias("source")).agg(F.max("target_share").alias("share"), F.max("max_repeats").alias("repeats")).where("source IS NOT NULL").orderBy("source").limit(MAX_SOURCES + 1).collect()
    if len(wanted) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    names = {w.source for w in wanted}
    listed = F.when(F.col("source").isin(sorted(names)), F.col("source")) if names else F.lit(None).cast("string")
    rows = _totals(sized.withColumn("source", listed), _block(seed)).collect()  # at most (sources + 1) x BLOCKS rows
    corpus = sum(r.tokens for r in rows)
    total = corpus if total_tokens is None else total_tokens
    rng = np.random.default_rng(seed)
    order = {w.source: rng.permutation(BLOCKS) for w in wanted}
    by: dict[str, dict[int, tuple[int, int]]] = {w.source: {} for w in wanted}
    for r in rows:
        if r.source is not None:
            by[r.source][r.block] = (r.tokens, r.docs)

    facts, uses, widths, partial = {}, [], [], {}
    room = max(1, MAX_USES // max(1, len(wanted)))
    for w in wanted:
        share, repeats, own = float(w.share or 0), int(w.repeats or 0), by[w.source]
        available = sum(t for t, _ in own.values())
        want = share * total
        quota = int(min(want, repeats * available))
        passes, rest = divmod(quota, available) if available else (0, 0)
        mine, width, last = uses_of(own, order[w.source], passes, rest, room)
        if last:
            partial[w.source] = (*last, passes)
        uses.append(mine)
        widths.append((w.source, width))
        facts[w.source] = (share, repeats, sum(d for _, d in own.values()), available, want, quota)

    n_uses = sum(map(len, uses))
    shards = shards or max(LEAST_SHARDS, min(-(-sum(f[5] for f in facts.values()) // TOKENS_PER_SHARD), n_uses))
    dealt: dict[int, np.ndarray] = {}
    if uses:
        _deal(rng, np.array([len(u) for u in uses], np.int64), 0, shards, dealt)
    taken, plan = [0] * len(uses), []
    for shard in sorted(dealt):
        for k, n in enumerate(dealt[shard]):
            for b, p, copies in uses[k][taken[k] : taken[k] + int(n)]:
                source = wanted[k].source
                plan.append((source, b, p, copies, shard, source in partial and (b, p) == (partial[source][0], partial[source][2])))
            taken[k] += int(n)

    # Their numbers depend on weights and bounds, not on the corpus; they are broadcast only within the bound.
    few = lambda made, n: F.broadcast(made) if n <= 2 * MAX_USES else made
    deal = spark.createDataFrame(plan, "source string, use int, first int, copies int, shard int, in_part boolean")
    wide = spark.createDataFrame(widths, "source string, width int")
    blocked = sized.join(F.broadcast(wide), "source").withColumn("use", F.floor(_block(seed) / F.col("width")).cast("int"))
    placed = blocked.join(few(deal, len(plan)), ["source", "use"])
    whole = placed.where("NOT in_part")
    part = _in_part(cut(placed.where("in_part")), {s: rest for s, (_, rest, _) in partial.items()}, seed, few) if partial else whole.limit(0)
    copied = whole.unionByName(part.select(whole.columns)).withColumn("copy_no", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("copies") - 1)))
    keyed = copied.select("doc_id", "source", "copy_no", "shard", F.xxhash64("doc_id", "copy_no", F.lit(seed + 1)).alias("shuffle_key"), "n_tokens")
    made = cut(keyed.repartitionById(shards, "shard").sortWithinPartitions("shard", "shuffle_key"))

    reached = {r.source: r.tokens for r in made.groupBy("source").agg(F.sum("n_tokens").alias("tokens")).collect()}  # at most MAX_SOURCES rows
    report = []
    for source, (share, repeats, docs, available, want, quota) in facts.items():
        got = reached.get(source, 0)
        report.append((source, share, repeats, docs, available, int(round(want)), quota, got, not (got >= repeats * available and got < want), total))
    schema = "source string, target_share double, max_repeats int, documents long, tokens_available long, tokens_wanted long, tokens_quota long, tokens_reached long, reachable boolean, total_tokens long"
    return Mix(made, spark.createDataFrame(report, schema))


def _in_part(rows: DataFrame, rest: dict[str, int], seed: int, few) -> DataFrame:
    """Of one block of each source as many documents as fill the rest of its quota.

    The block is cut into BLOCKS parts by another hash; whole parts are taken while they fit, and of the first that does
    not the documents in hash order while they fit.
    """
    spark = rows.sparkSession
    cut_again = F.pmod(F.xxhash64("doc_id", F.lit(seed + 3)), F.lit(BLOCKS)).cast("int")
    totals: dict[str, list] = {}
    for r in _totals(rows, cut_again).orderBy("source", "block").collect():  # at most MAX_SOURCES x BLOCKS rows
        totals.setdefault(r.source, []).append(r)
    chosen = []
    for source, parts in totals.items():
        left = rest[source]
        for r in parts:
            if r.tokens <= left:
                chosen.append((source, r.block, None))
                left -= r.tokens
            else:
                chosen.append((source, r.block, int(left)))
                break
    kept = rows.withColumn("part", cut_again).join(few(spark.createDataFrame(chosen, "source string, part int, only long"), len(chosen)), ["source", "part"])
    run = F.sum("n_tokens").over(Window.partitionBy("source").orderBy(F.xxhash64("doc_id", F.lit(seed + 2)), "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    last = kept.where("only IS NOT NULL").withColumn("run", run).where("run <= only").drop("run")
    return kept.where("only IS NULL").unionByName(last)


def shares(mixed: Mix) -> DataFrame:
    """The report with rows, share of the sample and the largest use of a document."""
    per_doc = mixed.sample.groupBy("source").agg(F.count("*").alias("rows_used"), F.max("copy_no").alias("last_copy"))
    all_tokens = mixed.report.agg(F.sum("tokens_reached").alias("all_reached"))
    return (
        mixed.report.join(per_doc, "source", "left")
        .crossJoin(F.broadcast(all_tokens))  # one row
        .select(*mixed.report.columns, F.coalesce("rows_used", F.lit(0)).alias("rows_used"), (F.coalesce("last_copy", F.lit(-1)) + 1).alias("uses_of_a_document"), F.try_divide("tokens_reached", "all_reached").alias("actual_share"))
    )
