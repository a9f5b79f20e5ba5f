"""Left joins that are gated by key overlap and record conflicts."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.missing import no_cell

#: Join keys, the most specific first.
KEY_PRIORITY = ("sample_id", "subject_id", "ncbi_accession", "study_name")
OVERLAP = 0.9
ORDER = "row_idx"
CONFLICTS = "__conflicts__"


@dataclass
class JoinLog:
    """What was joined to the anchor, on which key and with what overlap; and what was not, and why."""

    anchor: str
    joined: list[dict] = field(default_factory=list)
    skipped: list[dict] = field(default_factory=list)


def _columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in (ORDER, CONFLICTS)]


def pick_anchor(tables: list[tuple[str, DataFrame]], keys: tuple[str, ...] = KEY_PRIORITY) -> int:
    """The first table with the best-ranked key."""
    ranks = [next((i for i, k in enumerate(keys) if k in _columns(df)), len(keys)) for _, df in tables]
    return ranks.index(min(ranks))


def shared_key(left: DataFrame, right: DataFrame, keys: tuple[str, ...] = KEY_PRIORITY) -> str | None:
    """The best-ranked key that both have; the overlap has no say in it."""
    return next((k for k in keys if k in _columns(left) and k in _columns(right)), None)


def key_overlap(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row: n_left distinct keys of the left side, n_shared that the right side has, and their share (0 if none)."""
    l = left.where(~no_cell(F.col(key))).select(F.col(key).cast("string").alias("k")).distinct()
    r = right.where(~no_cell(F.col(key))).select(F.col(key).cast("string").alias("k")).distinct().withColumn("hit", F.lit(1))
    out = l.join(r, "k", "left").agg(F.count("*").alias("n_left"), F.count("hit").alias("n_shared"))
    return out.withColumn("overlap", F.coalesce(F.try_divide("n_shared", "n_left"), F.lit(0.0)))


def first_by_key(df: DataFrame, key: str) -> DataFrame:
    """Of each non-blank key the row that comes first."""
    rest = [c for c in _columns(df) if c != key]
    picked = df.where(~no_cell(F.col(key))).groupBy(F.col(key).cast("string").alias(key)).agg(F.min_by(F.struct(F.lit(True).alias("__hit"), *rest), ORDER).alias("__row"))
    return picked.select(F.col(key).alias("__key"), *[F.col(f"__row.{c}").alias(f"__r_{c}") for c in ["__hit", *rest]])


def merge_right(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """left with right's columns by key: blanks are filled, differing values stay and are noted as conflicts.

    Conflicts are a map from column to the right side's value; a later table's
    value replaces an earlier one's.  No row is added or lost.
    """
    found = first_by_key(right, key)
    joined = left.join(found, (F.col(key).cast("string") == F.col("__key")) & ~no_cell(F.col(key)), "left")
    hit = F.coalesce(F.col("__r___hit"), F.lit(False))
    out: dict[str, Column] = {}
    noted: list[Column] = []
    for c in _columns(right):
        if c == key:
            continue
        theirs = F.col(f"__r_{c}")
        if c not in left.columns:
            out[c] = theirs
            continue
        mine = F.col(c)
        clash = hit & ~no_cell(mine) & ~mine.eqNullSafe(theirs)
        out[c] = F.when(hit & ~clash, theirs).otherwise(mine)
        noted.append(F.struct(F.lit(c).alias("key"), F.when(clash, F.coalesce(theirs.cast("string"), F.lit(""))).alias("value")))
    notes = F.map_from_entries(F.filter(F.array(*noted), lambda x: x["value"].isNotNull())) if noted else F.create_map().cast("map<string,string>")
    old = F.col(CONFLICTS) if CONFLICTS in left.columns else F.create_map().cast("map<string,string>")
    out[CONFLICTS] = F.map_zip_with(old, notes, lambda k, x, y: F.coalesce(y, x))
    kept = [F.col(c) for c in left.columns if c not in out]
    return joined.select(*kept, *[v.alias(c) for c, v in out.items()])


def join_tables(tables: list[tuple[str, DataFrame]], keys: tuple[str, ...] = KEY_PRIORITY, threshold: float = OVERLAP) -> tuple[DataFrame, JoinLog]:
    """Joins all tables to the anchor, in order, where keys overlap enough.

    Keys and overlaps are those of the anchor as it came; rows are looked up
    by the row as merged so far.  A driver action a table decides the gate.
    """
    anchor = pick_anchor(tables, keys)
    name, base = tables[anchor]
    log = JoinLog(name)
    if len(tables) == 1:
        return base, log

    def step(merged: DataFrame, item: tuple[str, DataFrame]) -> DataFrame:
        other, right = item
        key = shared_key(base, right, keys)
        if key is None:
            log.skipped.append({"right": other, "reason": "no shared key"})
            return merged
        overlap = key_overlap(base, right, key).first().overlap
        if overlap < threshold:
            log.skipped.append({"right": other, "reason": f"overlap of {key} is {overlap:.2f}, below {threshold}"})
            return merged
        log.joined.append({"right": other, "key": key, "overlap": round(overlap, 3)})
        return merge_right(merged, right, key)

    return reduce(step, [t for i, t in enumerate(tables) if i != anchor], base), log


def union_columns(tables: list[DataFrame]) -> DataFrame:
    """All rows under the union of the columns, in first-seen order; what a table lacks is ''."""
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
    return out if len(tables) == 1 else out.na.fill("")


def fallback(own: DataFrame, spare: DataFrame, by: str) -> DataFrame:
    """own's rows, and of spare those whose `by` own has none of."""
    return own.unionByName(spare.join(own.select(by).distinct(), by, "left_anti"), allowMissingColumns=True)


def last_by_label(table: DataFrame, label: str, value: str, order: str) -> DataFrame:
    """A label -> value lookup in which the last row of a label counts."""
    return table.groupBy(label).agg(F.max_by(value, order).alias(value))
