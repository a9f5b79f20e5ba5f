"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Each source's documents are dealt into blocks by a hash, and its blocks are put
into a permuted order.  A source's target number of words becomes an exact quota
of blocks of that order (a source that is wanted more than once is drawn again;
the last block is drawn in part).  A binary tree splits the vector of quotas
among output shards: every node hands a multivariate hypergeometric share of
its blocks to its left half.  A leaf of the tree is a shard: it draws the run of
every source's permuted blocks that the tree left to it, disjoint from all other
shards' runs, and shuffles its documents locally.

The driver holds a row for each source and the top of the tree; the tree's lower
parts, the blocks and the draws are tables.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._store import discard, map_batches, materialize

#: Fixed by the contract: weights of the sources in code point order, in turn.
WEIGHTS = (3, 1, 2)
TOTAL_SHARE = 1.5
MOST_REPEATS = 2.0
#: Words an output shard should hold, and a block; a source has no fewer blocks than this.
SHARD_WORDS = 2_000_000
BLOCK_WORDS = SHARD_WORDS // 16
LEAST_BLOCKS = 64
#: Subtrees that the driver hands to executors, and the most tasks that shards are dealt to.
SUBTREES = 256
MOST_TASKS = 20_000
#: A table of so many rows (some tens of bytes each) may be broadcast; a larger one is joined as Spark sees fit.
BROADCAST_ROWS = 1_000_000
SEED = 29


def targets(sizes: list[int], weights: list[float], total: float, most: float = MOST_REPEATS) -> list[float]:
    """Words wanted of each source: shares of `total` by weight, none above `most` times its size.

    What a source cannot take is shared again by weight among the others, until none is above.
    """
    out = [0.0] * len(sizes)
    free, left = set(range(len(sizes))), float(total)
    while free:
        weight = sum(weights[i] for i in sorted(free))
        full = [i for i in sorted(free) if left * weights[i] / weight > most * sizes[i]]
        if not full:
            for i in free:
                out[i] = left * weights[i] / weight
            break
        spare = left
        for i in full:
            out[i] = most * sizes[i]
            spare -= out[i]
            free.discard(i)
        left = spare
    return out


def split_tree(low: int, high: int, first: np.ndarray, quotas: np.ndarray, seed: int, width: int = 1) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Nodes (low, high, first, quotas) of at most `width` shards that share the blocks of shards low..high-1.

    quotas: blocks of each source; first: the place of the node's first block in
    each source's permuted order.  Each node draws by a generator of its own, so
    that a part of the tree gives the same wherever it is worked out.
    """
    work = [(low, high, first, quotas)]
    while work:
        lo, hi, begin, quota = work.pop()
        if hi - lo <= width:
            yield lo, hi, begin, quota
            continue
        mid = (lo + hi) // 2
        rng = np.random.default_rng([seed, lo, hi])
        left = np.zeros_like(quota)
        rest = int(quota.sum())
        need = round(rest * (mid - lo) / (hi - lo))
        for i, q in enumerate(quota.tolist()):  # conditional draws of one source after another make the joint draw
            rest -= q
            left[i] = _hypergeometric(rng, q, rest, need)
            need -= int(left[i])
        work += [(mid, hi, begin + left, quota - left), (lo, mid, begin, left)]


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, sample: int) -> int:
    if sample <= 0 or good <= 0:
        return 0
    if bad <= 0:
        return min(good, sample)
    return int(rng.hypergeometric(good, bad, sample))


def _order(seed: int, key: str, text: str) -> Column:
    """The hash that permutes documents; equal rows are equal in it."""
    return F.xxhash64(F.lit(seed), F.col(key).cast("string"), F.coalesce(F.col(text).cast("string"), F.lit("")))


def _small(df: DataFrame, rows: int) -> DataFrame:
    """df, to be broadcast if its counted rows are few."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


@dataclass(frozen=True)
class Plan:
    """sizes: doc_id, source, size, order of every document.  sources: no, source, source_size, target, blocks, whole, rest.
    draws: no, block and the list of (shard, cut) that draw it; a draw takes the documents whose order is at most cut (null: all).
    """

    sizes: DataFrame
    sources: DataFrame
    draws: DataFrame
    n_sources: int
    n_draws: int
    shards: int
    seed: int

    def placed(self, rows: DataFrame, source: str, order: str) -> DataFrame:
        """rows with the columns of their source, and their block."""
        joined = rows.join(_small(self.sources.withColumnRenamed("source", "source_name"), self.n_sources), F.col(source).eqNullSafe(F.col("source_name")))
        return joined.withColumn("block", F.pmod(F.xxhash64(F.lit(self.seed + 1), order), "blocks").cast("int"))

    def drawn(self, placed: DataFrame, order: str) -> DataFrame:
        """Placed rows with `shards`: the shard of each of their copies."""
        joined = placed.join(_small(self.draws, self.n_draws), ["no", "block"], "left")
        hit = F.filter("draws", lambda x: x["cut"].isNull() | (F.col(order) <= x["cut"]))
        return joined.withColumn("shards", F.coalesce(F.transform(hit, lambda x: x["shard"]), F.array().cast("array<int>")))


def _permuted(held: DataFrame, seed: int) -> DataFrame:
    """(no, block, words, place, before): each block's place in its source's permuted order, and the words before it.

    Sums over 1024 ranges of the permuting hash come first, then running sums
    inside each range, so that no task orders all blocks of a source.
    """
    ranked = held.withColumn("h", F.xxhash64(F.lit(seed + 3), "no", "block")).withColumn("span", F.shiftrightunsigned("h", 54))
    until = Window.partitionBy("no").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    spans = ranked.groupBy("no", "span").agg(F.sum("words").alias("w"), F.count("*").alias("n"))
    bases = spans.select("no", "span", F.coalesce(F.sum("w").over(until), F.lit(0)).alias("base"), F.coalesce(F.sum("n").over(until), F.lit(0)).alias("skipped"))
    inside = Window.partitionBy("no", "span").orderBy("h", "block")
    running = ranked.join(bases, ["no", "span"]).withColumns({"sum": F.sum("words").over(inside), "k": F.row_number().over(inside)})
    return running.select("no", "block", "words", (F.col("skipped") + F.col("k") - 1).alias("place"), (F.col("base") + F.col("sum") - F.col("words")).alias("before"))


def _leaves(spark: SparkSession, quotas: np.ndarray, rounds: np.ndarray, shards: int, seed: int) -> DataFrame:
    """(no, place, round, shard): every block draw of every leaf of the tree; rounds: blocks of a whole round of each source."""
    top = split_tree(0, shards, np.zeros_like(quotas), quotas, seed, -(-shards // SUBTREES))
    rows = [(lo, hi, first.tolist(), quota.tolist()) for lo, hi, first, quota in top]
    subtrees = spark.createDataFrame(rows, "low int, high int, first array<long>, quotas array<long>").repartition(min(len(rows), spark.sparkContext.defaultParallelism))

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                for shard, _, first, quota in split_tree(r["low"], r["high"], np.array(r["first"], np.int64), np.array(r["quotas"], np.int64), seed):
                    no = np.repeat(np.arange(len(quota)), quota)
                    at = first[no] + np.arange(len(no)) - np.repeat(np.cumsum(quota) - quota, quota)
                    arrays = [no.astype(np.int32), at % rounds[no], (at // rounds[no]).astype(np.int32), np.full(len(no), shard, np.int32)]
                    yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], ["no", "place", "round", "shard"])

    return map_batches(subtrees, expand, "no int, place long, round int, shard int")


def _cuts(placed: DataFrame, last: DataFrame) -> DataFrame:
    """(no, cut): the order up to which a source's last block is taken, so that its words come nearest to those left.

    last: (no, block, left), one block a source.  Documents of one hash (equal
    rows) go together; there is no row where taking none is nearest.
    """
    running = F.sum("size").over(Window.partitionBy("no").orderBy("order"))
    near = placed.select("no", "block", "order", "size").join(F.broadcast(last), ["no", "block"]).withColumn("off", F.abs(running - F.col("left")))  # a row a source
    best = near.groupBy("no").agg(F.min(F.struct("off", "order")).alias("x"), F.first("left").alias("left"))
    return best.where("x.off < left").select("no", F.col("x.order").alias("cut"))


def plan_mix(
    docs: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    source: str = "source",
    total_share: float = TOTAL_SHARE,
    weights: tuple[int, ...] = WEIGHTS,
    shards: int | None = None,
    seed: int = SEED,
) -> Plan:
    """What every source gives to every shard."""
    spark = docs.sparkSession
    narrow = docs.select(
        F.col(key).alias("doc_id"),
        F.col(source).cast("string").alias("source"),
        F.regexp_count(F.coalesce(F.col(text).cast("string"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("size"),
        _order(seed, key, text).alias("order"),
    )
    sizes = materialize(narrow, "sizes")
    total = {r.source: r.words for r in sizes.groupBy("source").agg(F.sum("size").alias("words")).collect()}
    names = sorted((s for s in total if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in total)
    wanted = targets([total[s] for s in names], [weights[i % len(weights)] for i in range(len(names))], total_share * sum(total.values()))
    rows = []
    for no, (s, want) in enumerate(zip(names, wanted)):
        whole = int(want // total[s]) if total[s] else 0
        rows.append((no, s, total[s], want, max(LEAST_BLOCKS, -(-total[s] // BLOCK_WORDS)), whole, want - whole * total[s]))
    sources = spark.createDataFrame(rows, "no int, source string, source_size long, target double, blocks long, whole int, rest double")
    shards = shards or max(1, math.ceil(sum(wanted) / SHARD_WORDS))
    plan = Plan(sizes, sources, sources, len(names), 0, shards, seed)
    placed = plan.placed(sizes, "source", "order")
    held = placed.groupBy("no", "block", "whole", "rest").agg(F.sum("size").alias("words"))
    permuted = _permuted(held.select("no", "block", "words"), seed)
    runs = materialize(permuted.join(_small(sources.select("no", "whole", "rest"), len(names)), "no"), "runs")
    some = F.col("before") < F.col("rest") - 0.5  # of the round that is not whole
    counted = runs.groupBy("no").agg(F.count("*").alias("n"), F.first("whole").alias("whole"), F.count_if(some).alias("some")).collect()
    rounds, quotas = np.ones(len(names), np.int64), np.zeros(len(names), np.int64)
    for r in counted:
        rounds[r.no], quotas[r.no] = r.n, r.whole * r.n + r.some
    part = (F.col("round") == F.col("whole")) & (F.col("before") + F.col("words") > F.col("rest"))
    left = F.when(part, F.col("rest") - F.col("before"))
    found = _leaves(spark, quotas, rounds, shards, seed).join(runs, ["no", "place"]).select("no", "block", "shard", left.alias("left"))
    found = materialize(found, "leaves")
    last = found.where("left IS NOT NULL")
    cuts = last.join(_cuts(placed, last.select("no", "block", "left")), "no").select("no", "block", "shard", "cut")
    draws = found.where("left IS NULL").select("no", "block", "shard", F.lit(None).cast("long").alias("cut")).unionByName(cuts)
    listed = materialize(draws.groupBy("no", "block").agg(F.collect_list(F.struct("shard", "cut")).alias("draws")), "draws")  # at most one a round
    discard(runs, found)
    return Plan(sizes, sources, listed, len(names), int(quotas.sum()), shards, seed)


def mix_counts(docs: DataFrame, **options) -> DataFrame:
    """One row for each document: doc_id, size, source_size, target, taken, shards.

    shards lists the output shard of every copy that the mix takes; taken is
    the words of all copies.  A null text has size 0, a null source is a source
    of its own and comes last.  Equal rows are taken alike.  Sources without
    words have target 0; an empty table gives no rows.
    """
    plan = plan_mix(docs, **options)
    out = plan.drawn(plan.placed(plan.sizes, "source", "order"), "order")
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("shards")).alias("taken"), "shards")


def mix(docs: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source", **options) -> DataFrame:
    """The rows of the mix, with all columns of `docs`, a row for each copy taken.

    Rows of one shard stand together, in an order shuffled by a hash; a task has
    one shard, or a run of them where there are very many.  Nulls, equal rows
    and empty tables are treated as mix_counts treats them.
    """
    plan = plan_mix(docs, text, key, source, **options)
    discard(plan.sizes)
    names = [f"c{i}" for i in range(len(docs.columns))]
    plain = docs.select(*[F.col(c).alias(n) for c, n in zip(docs.columns, names)], F.col(source).cast("string").alias("of"), _order(plan.seed, key, text).alias("order"))
    copies = plan.drawn(plan.placed(plain, "of", "order"), "order").select(*names, "order", F.posexplode("shards").alias("copy", "shard"))
    tasks = min(plan.shards, MOST_TASKS)
    dealt = copies.repartitionById(tasks, (F.col("shard").cast("long") * tasks / plan.shards).cast("int"))
    local = dealt.sortWithinPartitions("shard", F.xxhash64(F.lit(plan.seed + 2), "order", "copy", "shard"))
    return local.select(*[F.col(n).alias(c) for c, n in zip(docs.columns, names)])


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract query: what the mix takes of every document, and the shards that its copies go to.

    Nulls, ties, equal rows and empty tables: as in mix_counts.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    shards = F.array_join(F.transform("shards", lambda x: x.cast("string")), ",")
    return mix_counts(docs).withColumn("shards", shards)
