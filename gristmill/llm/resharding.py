"""Minimum-cost-flow resharding: old shards are brought to new capacities by moving the fewest bytes.

Old shard sizes are supplies, new capacities are demands, and a byte that stays
in its shard costs nothing.  A minimum-cost flow says how many bytes go from each
old shard to each new one.  Every old shard is a row of blocks (groups of
documents, or files); prefix sums over blocks, then inside them, give each
document its place, and the flow cuts the row into stretches: the first stays,
each other goes to one new shard.  So whole blocks move, and only the few
blocks at a cut are split between documents.  The documents themselves, with all
their columns, are then shuffled by block and written to their new shards.

The driver holds one row an old shard (for stored files, one a file), and what
Spark broadcasts of the table of blocks.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._store import _path, discard, materialize, numbered

#: Bytes of documents that a block should hold, and the least number of blocks of an old shard.
BLOCK_BYTES = 64 << 20
LEAST_BLOCKS = 64


def even_capacities(total: int, shards: int) -> list[int]:
    """`total` in `shards` parts that differ by one at most."""
    return [total // shards + (k < total % shards) for k in range(shards)]


def staying_is_free(old: int, new: int) -> np.ndarray:
    """Cost of a byte from each old shard to each new one: 0 where the number stays, else 1."""
    return 1 - np.eye(old, new, dtype=np.int64)


def min_cost_flow(supplies: Sequence[int], capacities: Sequence[int], cost: np.ndarray) -> np.ndarray:
    """flow[i, j] >= 0 that ships all supplies within the capacities at the least sum of flow * cost.

    Successive shortest paths: potentials keep the costs of what is left not
    negative, so Dijkstra finds each next path, over all nodes at once.  `cost`
    holds whole numbers, none negative.
    """
    cost = np.asarray(cost, np.int64)
    left, room = np.array(supplies, np.int64), np.array(capacities, np.int64)
    if left.sum() > room.sum():
        raise ValueError(f"capacities hold {room.sum()} of {left.sum()}")
    flow = np.zeros(cost.shape, np.int64)
    far = np.iinfo(np.int64).max // 4
    from_old, from_new = np.zeros(len(left), np.int64), np.zeros(len(room), np.int64)
    while left.any():
        at_old, at_new = np.where(left > 0, 0, far), np.full(len(room), far)
        by_old, by_new = np.full(len(left), -1), np.full(len(room), -1)
        open_old, open_new = np.ones(len(left), bool), np.ones(len(room), bool)
        while True:
            i = int(np.where(open_old, at_old, far + 1).argmin())
            j = int(np.where(open_new, at_new, far + 1).argmin())
            if open_old[i] and at_old[i] <= at_new[j]:
                open_old[i] = False
                way = at_old[i] + cost[i] + from_old[i] - from_new
                nearer = open_new & (way < at_new)
                at_new[nearer], by_new[nearer] = way[nearer], i
            elif room[j] > 0:
                break
            else:  # a full shard can take what another one takes back
                open_new[j] = False
                way = at_new[j] - cost[:, j] + from_new[j] - from_old
                nearer = open_old & (flow[:, j] > 0) & (way < at_old)
                at_old[nearer], by_old[nearer] = way[nearer], j
        from_old += np.minimum(at_old, at_new[j])
        from_new += np.minimum(at_new, at_new[j])
        path, to = [], j
        while True:
            i = int(by_new[to])
            path.append((i, to))
            if by_old[i] < 0:
                break
            to = int(by_old[i])
        back = [(i, to) for (i, _), (_, to) in zip(path, path[1:])]
        amount = min([left[path[-1][0]], room[j], *[flow[x] for x in back]])
        for x in path:
            flow[x] += amount
        for x in back:
            flow[x] -= amount
        left[path[-1][0]] -= amount
        room[j] -= amount
    return flow


def _sections(spark: SparkSession, flow: np.ndarray) -> DataFrame:
    """(old, ends, shards): up to which byte of an old shard's row each new shard takes; what stays comes first."""
    rows = []
    for i, amounts in enumerate(flow.tolist()):
        order = sorted((j for j, x in enumerate(amounts) if x), key=lambda j: (j != i, j))
        rows.append((i, np.cumsum([amounts[j] for j in order], dtype=np.int64).tolist(), order))
    return spark.createDataFrame(rows, "old int, ends array<long>, shards array<int>")


def _dealt(rows: DataFrame, flow: np.ndarray, name: str) -> DataFrame:
    """rows (old, block, number, size, ...) with shard and slot.

    A document goes where its middle byte lies; slots follow old shard, block and
    number.  Sizes alone are shuffled to count what each shard takes of a block,
    then whole rows are shuffled once, by block.
    """
    spark = rows.sparkSession
    before = Window.partitionBy("old").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.select("old", "block", "number", "size")
    blocks = sizes.groupBy("old", "block").agg(F.sum("size").alias("bytes"))
    bases = materialize(blocks.select("old", "block", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("base")), f"{name}-bases")
    inside = Window.partitionBy("old", "block").orderBy("number")
    until = F.col("base") + F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    shard = F.get("shards", F.size(F.filter("ends", lambda e: 2 * e <= F.col("middle"))))
    sections = F.broadcast(_sections(spark, flow))  # a row an old shard, with the few new shards that it gives to

    def cut(rows: DataFrame) -> DataFrame:
        placed = rows.join(bases, ["old", "block"]).withColumns({"middle": 2 * until - F.col("size"), "row": F.row_number().over(inside)})
        return placed.join(sections, "old").withColumn("shard", shard).drop("base", "middle", "ends", "shards")

    groups = cut(sizes).groupBy("shard", "old", "block").agg(F.count("*").alias("n"), F.min("row").alias("first"))
    earlier = Window.partitionBy("shard").orderBy("old", "block").rowsBetween(Window.unboundedPreceding, -1)
    starts = groups.select("shard", "old", "block", (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first")).alias("start"))
    starts = materialize(starts, f"{name}-starts")
    return cut(rows).join(starts, ["shard", "old", "block"]).withColumn("slot", F.col("start") + F.col("row")).drop("start", "row")


def text_bytes(text: Column) -> Column:
    """What a document takes in a shard: the UTF-8 bytes of its text (null: none) and one."""
    return F.coalesce(F.octet_length(text).cast("long"), F.lit(0)) + 1


def reshard(
    docs: DataFrame,
    old: Column,
    old_shards: int,
    shards: int | None = None,
    capacities: Sequence[int] | None = None,
    cost: np.ndarray | None = None,
    text: str = "text",
    key: str = "doc_id",
    block_bytes: int = BLOCK_BYTES,
    folder: str | None = None,
) -> DataFrame:
    """Writes all documents to their new shards, as folder/shard=K/*.parquet, and returns them as stored there.

    A stored row has all columns of the document, old_shard, slot and shard, in
    place of columns of docs that had these names; what is returned has size and
    text_crc32 besides, of the text as stored.  Files hold documents in order of
    slot.  Without `folder` the shards lie in the shared folder until the driver
    ends.  rewrite() may take them further; it moves rows as they are, old_shard
    and slot included.

    `old` is the old shard, 0 .. old_shards - 1; others and null are an error.
    Either `shards` new shards get even capacities, or `capacities` has bytes for
    each.  A new shard's bytes differ from what the flow gives it by half a
    document at most for each old shard that it is cut from.  Slots are gapless
    from 0 in each shard.  A null text has size 1; null, equal and any sortable
    keys count as rows of their own; an empty table gives no rows.
    """
    told = {"old_shard", "slot", "shard"}
    if {key.lower(), text.lower()} & (told | {"size", "text_crc32"}):
        raise ValueError(f"{key} or {text} would be replaced by a column of the result")
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    crc = F.crc32(F.coalesce(F.col(text).cast("string"), F.lit("")))
    taken = materialize(docs.select(F.col(key).alias("key"), old.cast("int").alias("old"), text_bytes(F.col(text)).alias("size"), crc.alias("crc"), own.alias("doc")), "reshard")
    rows = numbered(taken, "key", "crc", "number").drop("key", "crc")
    if not set(rows.inputFiles()) & set(taken.inputFiles()):  # it was written anew with its numbers
        discard(taken)
    supplies = [0] * old_shards
    for r in rows.groupBy("old").agg(F.sum("size").alias("bytes")).collect():
        if r.old is None or not 0 <= r.old < old_shards:
            raise ValueError(f"old shard {r.old} is not in 0 .. {old_shards - 1}")
        supplies[r.old] = r.bytes
    capacities = list(capacities) if capacities is not None else even_capacities(sum(supplies), shards)
    flow = min_cost_flow(supplies, capacities, staying_is_free(old_shards, len(capacities)) if cost is None else cost)
    counts = F.array(*[F.lit(max(LEAST_BLOCKS, -(-s // block_bytes))) for s in supplies])
    block = F.pmod(F.xxhash64("number"), F.get(counts, F.col("old")))
    kept = [F.col("doc")[c].alias(c) for c in docs.columns if c.lower() not in told]
    dealt = _dealt(rows.withColumn("block", block), flow, "reshard").select(*kept, F.col("old").alias("old_shard"), "slot", "shard")
    stored = materialize(dealt.sortWithinPartitions("shard", "slot"), "shards", ["shard"], folder)
    discard(rows)
    return stored.withColumns({"size": text_bytes(F.col(text)), "text_crc32": crc})


# ------------------------------------------------------------- stored shards


def _moves(spark: SparkSession, folder: str):
    return _path(spark, f"{folder}/_next/moves.json")


def finish(spark: SparkSession, folder: str) -> bool:
    """Completes a rewriting that was broken off after its moves were settled, or clears one broken off before; whether there was one.

    Each move is done only if it is still to do, so this may be broken off and called again.
    """
    system, moves = _moves(spark, folder)
    _, next_folder = _path(spark, f"{folder}/_next")
    if not system.exists(next_folder):
        return False
    if system.exists(moves):
        for source, target in json.loads(spark.read.text(moves.toString(), wholetext=True).first()[0]):
            _, a = _path(spark, source)
            if not system.exists(a):
                continue
            if target is None:
                system.delete(a, False)
            else:
                _, b = _path(spark, target)
                system.mkdirs(b.getParent())
                if not system.rename(a, b):
                    raise OSError(f"{source} could not be moved to {target}")
    system.delete(next_folder, True)
    return True


def rewrite(spark: SparkSession, folder: str, shards: int | None = None, capacities: Sequence[int] | None = None, cost: np.ndarray | None = None, text: str = "text") -> DataFrame:
    """Reshards Parquet files stored as folder/shard=K/*.parquet; returns (old, shard, bytes) of the flow.

    A file is a block.  Files that go whole are renamed, files at a cut are
    written anew, all others stay untouched.  New files are written beside the
    table, then the list of moves is written, then the moves are done: what is
    broken off before the list leaves the table as it was, what is broken off
    after it is completed by the next call or by finish().  Only one rewriting of
    a folder may run at a time, and readers should wait for it.
    """
    finish(spark, folder)
    table = spark.read.option("basePath", folder).parquet(folder)
    names = [c for c in table.columns if c != "shard"]
    read = table.select(F.col("shard").cast("int").alias("old"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("number"), text_bytes(F.col(text)).alias("size"))
    narrow = materialize(read, "stored")
    files = narrow.groupBy("old", "file").agg(F.sum("size").alias("bytes")).orderBy("old", "file").collect()  # a row a file
    old_shards = max((r.old for r in files), default=-1) + 1
    supplies = [sum(r.bytes for r in files if r.old == i) for i in range(old_shards)]
    capacities = list(capacities) if capacities is not None else even_capacities(sum(supplies), shards)
    flow = min_cost_flow(supplies, capacities, staying_is_free(old_shards, len(capacities)) if cost is None else cost)
    moved = [(i, j, int(x)) for (i, j), x in np.ndenumerate(flow) if x]
    report = spark.createDataFrame(moved, "old int, shard int, bytes long")
    if all(i == j for i, j, _ in moved):
        discard(narrow)
        return report
    numbers = spark.createDataFrame([(r.file, k) for k, r in enumerate(files)], "file string, block long")
    dealt = materialize(_dealt(narrow.join(numbers, "file"), flow, "stored").select("old", "file", "number", "shard"), "stored-dealt")
    ways = dealt.groupBy("old", "file").agg(F.min("shard").alias("low"), F.max("shard").alias("high")).where("low <> old OR high <> old").collect()
    cut = [r.file for r in ways if r.low != r.high]
    moves = [(r.file, f"{folder}/shard={r.low}/{uuid.uuid4().hex}.parquet") for r in ways if r.low == r.high]
    system, settled = _moves(spark, folder)
    if cut:
        here = spark.read.option("basePath", folder).parquet(*cut).withColumns({"#file": F.col("_metadata.file_path"), "#number": F.col("_metadata.row_index")})
        at = dealt.where(F.col("file").isin(cut)).select(F.col("file").alias("#file"), F.col("number").alias("#number"), F.col("shard").alias("#to"))
        pieces = here.join(at, ["#file", "#number"]).repartition("#file", "#to").sortWithinPartitions("#file", "#to", "#number")
        pieces.select(*[f"`{c}`" for c in names], F.col("#to").alias("shard")).write.partitionBy("shard").parquet(f"{folder}/_next/data")
        for to in range(len(capacities)):
            _, made = _path(spark, f"{folder}/_next/data/shard={to}")
            if system.exists(made):
                moves += [(f.getPath().toString(), f"{folder}/shard={to}/{uuid.uuid4().hex}.parquet") for f in system.listStatus(made)]
        moves += [(file, None) for file in cut]
    _, draft = _path(spark, f"{folder}/_next/moves.tmp")
    out = system.create(draft, True)
    out.write(json.dumps(moves).encode())
    out.close()
    system.rename(draft, settled)
    finish(spark, folder)
    discard(narrow, dealt)
    return report


#: Fixed by the contract: new shards.  The old layout has fewer, by a hash of the key.
SHARDS = 8
OLD_SHARDS = 6


def op13_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract query: all documents of six shards by key hash written to eight shards of even bytes.

    Whole documents are written; what is returned is read from the new shards.
    Nulls, equal rows and empty tables: as in reshard.  A null doc_id stood in shard 0.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    old = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(OLD_SHARDS)), F.lit(0))
    out = reshard(docs, old, OLD_SHARDS, SHARDS)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard")
