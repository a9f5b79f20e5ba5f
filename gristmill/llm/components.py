"""Connected components of an undirected graph by alternating star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import discard, materialize


#: Parts into which the neighbours of a node are split for a join.
PARTS = 8


def _with_least(rows: DataFrame, least: DataFrame) -> DataFrame:
    """rows (u, v) with the m of their u, for each node in PARTS groups, so that a hub's neighbours are several tasks' work."""
    split = rows.withColumn("part", F.pmod(F.xxhash64("v"), F.lit(PARTS)).cast("int"))
    spread = least.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    return split.join(spread, ["u", "part"]).drop("part")


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node moves to the node's smallest neighbour (or the node)."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return _with_least(both, least).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, move to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = _with_least(edges, least).where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, u: str, v: str) -> DataFrame:
    """(node, label) of every node that has an edge; label is the smallest node of its component.

    Each round is written to the shared folder, and so is the result, which is
    the caller's to discard.
    """
    pairs = edges.where(F.col(u) != F.col(v))
    now = materialize(pairs.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct(), "edges")
    sign = None
    while True:
        before, now = now, materialize(_small_star(_large_star(now)), "edges")
        discard(before)
        mark = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        found = tuple(now.agg(F.count("*"), mark).collect()[0])
        if found == sign:
            break
        sign = found
    own = now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    labels = materialize(now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(own), "labels")
    discard(now)
    return labels
