"""Gated left joins of the tables of all studies at once.

Rows are (study, table_id, rank, row_idx, values map<string,string>); rank orders
a study's tables, the most relevant first, and every row of a table has all its
columns in `values`.  Per study the rules are those of `joins`: the anchor is
the first table with the best-ranked key, another table is joined by the
best-ranked key that both have, if enough of the anchor's keys are in it, and
differing values stay and are noted.

One aggregate over (study, key, value) decides every gate; then a round of
joins for each place in the order of tables, over all studies together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.missing import no_cell
from ..shared import written
from .joins import KEY_PRIORITY, OVERLAP

#: So many rows (some hundred bytes each) of gates may be broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 100_000


def _columns(rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(study, table_id, rank, has): which of the keys each table has among its columns."""
    has = [F.bool_or(F.map_contains_key("values", k)) for k in keys]
    return rows.groupBy("study", "table_id", "rank").agg(F.array(*has).alias("has"))


def gates(rows: DataFrame, keys: tuple[str, ...] = KEY_PRIORITY, threshold: float = OVERLAP) -> DataFrame:
    """One row a table: study, table_id, rank, is_anchor, key, n_left, n_shared, overlap, joined, reason.

    The anchor's own row has no key.  Overlap is the share of the anchor's
    distinct keys that the table has; it is 0 where the anchor has none.
    """
    tables = _columns(rows, keys)
    best = F.coalesce(F.nullif(F.array_position("has", True), F.lit(0).cast("long")), F.lit(len(keys) + 1))
    anchors = tables.groupBy("study").agg(F.min(F.struct(best.alias("best"), "rank", "table_id", "has")).alias("a"))
    shared = F.filter(F.transform(F.arrays_zip(F.col("a.has").alias("x"), F.col("has").alias("y")), lambda p, i: F.when(p["x"] & p["y"], i)), lambda i: i.isNotNull())
    sides = tables.join(anchors, "study").select("study", "table_id", "rank", (F.col("rank") == F.col("a.rank")).alias("is_anchor"), F.get(shared, F.lit(0)).alias("key_no"))

    # every table's distinct keys meet at their value; few tables of a study can
    entries = F.array(*[F.struct(F.lit(i).alias("key_no"), F.try_element_at("values", F.lit(k)).alias("value")) for i, k in enumerate(keys)])
    long = rows.select("study", "rank", F.inline(entries)).where(~no_cell(F.col("value")))
    at_value = long.groupBy("study", "key_no", "value").agg(F.collect_set("rank").alias("ranks"))
    anchor_rank = anchors.select("study", F.col("a.rank").alias("anchor"))
    there = at_value.join(anchor_rank, "study").where(F.array_contains("ranks", F.col("anchor")))
    shares = there.select("study", "key_no", F.explode("ranks").alias("rank")).groupBy("study", "key_no", "rank").agg(F.count("*").alias("n"))
    left = shares.join(anchor_rank, "study").where("rank = anchor").select("study", "key_no", F.col("n").alias("n_left"))
    counted = sides.join(left, ["study", "key_no"], "left").join(shares.withColumnRenamed("n", "n_shared"), ["study", "key_no", "rank"], "left")
    n_left, n_shared = (F.coalesce(c, F.lit(0)) for c in ("n_left", "n_shared"))
    overlap = F.coalesce(F.try_divide(n_shared, n_left), F.lit(0.0))
    other = ~F.col("is_anchor")
    joined = other & F.col("key_no").isNotNull() & (overlap >= threshold)
    reason = F.when(other & F.col("key_no").isNull(), "no shared key").when(other & ~joined, "overlap below the threshold")
    key = F.when(other, F.get(F.array(*map(F.lit, keys)), F.col("key_no")))
    some = other & F.col("key_no").isNotNull()
    return counted.select(
        "study", "table_id", "rank", "is_anchor", key.alias("key"), F.when(some, n_left).alias("n_left"), F.when(some, n_shared).alias("n_shared"), F.when(some, overlap).alias("overlap"), joined.alias("joined"), reason.alias("reason")
    )


def _merged(values: Column, conflicts: Column, theirs: Column) -> tuple[Column, Column]:
    """(values, conflicts) after a joined row: blanks are filled, what differs stays and is noted; the latest note counts."""
    filled = F.map_zip_with(values, theirs, lambda k, x, y: F.when(no_cell(x) & y.isNotNull(), y).otherwise(x))
    differs = F.map_filter(theirs, lambda k, y: ~no_cell(F.try_element_at(values, k)) & ~F.try_element_at(values, k).eqNullSafe(y))
    return F.when(theirs.isNull(), values).otherwise(filled), F.when(theirs.isNull(), conflicts).otherwise(F.map_zip_with(conflicts, differs, lambda k, x, y: F.coalesce(y, x)))


def join_studies(rows: DataFrame, keys: tuple[str, ...] = KEY_PRIORITY, threshold: float = OVERLAP) -> tuple[DataFrame, DataFrame]:
    """((study, row_idx, values, conflicts) of the anchors' rows, gates).  No row is added or lost.

    A row is looked up by its key as merged so far, in the first row of the
    other table that has it.  The gates are written to the shared folder; that
    and the count of rounds are all that runs here, whatever the number of
    studies.  Rounds are as many as a study has joined tables at most.
    """
    gate = written(gates(rows, keys, threshold))
    kept = gate.where("joined").withColumn("round", F.row_number().over(Window.partitionBy("study").orderBy("rank")))
    size = gate.agg(F.count("*").alias("n")).first().n
    rounds = kept.agg(F.coalesce(F.max("round"), F.lit(0)).alias("n")).first().n
    small = F.broadcast if size <= BROADCAST_ROWS else lambda df: df
    out = rows.join(small(gate.where("is_anchor").select("study", "rank")), ["study", "rank"]).select("study", "row_idx", "values", F.create_map().cast("map<string,string>").alias("conflicts"))
    for k in range(1, rounds + 1):
        now = kept.where(F.col("round") == k).select("study", "rank", "key")
        right = rows.join(small(now), ["study", "rank"]).select("study", "row_idx", "values", F.try_element_at("values", F.col("key")).alias("at"), "key").where(~no_cell(F.col("at")))
        first = right.groupBy("study", "at").agg(F.min_by(F.map_filter("values", lambda name, v: name != F.col("key")), "row_idx").alias("theirs"))
        keyed = out.join(small(now.select("study", "key")), "study", "left").withColumn("at", F.try_element_at("values", F.col("key")))
        met = keyed.join(first, ["study", "at"], "left")
        values, conflicts = _merged(F.col("values"), F.col("conflicts"), F.col("theirs"))
        out = met.select("study", "row_idx", values.alias("values"), conflicts.alias("conflicts"))
    return out, gate
