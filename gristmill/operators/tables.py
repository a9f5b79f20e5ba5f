"""Smaller table operations: missing columns, precedence, repeated runs, header limits."""

from __future__ import annotations

import dataclasses

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.missing import no_publication, no_term
from ..functions.strings import whole_id
from ..sources.schema import Schema

#: Fixed value: longest header that a mapper takes.
HEADER_LENGTH = 80


def without_missing(df: DataFrame, keep: tuple[str, ...] = (), missing=no_term) -> DataFrame:
    """df with tokens that mean missing as null, and without the columns that then hold nothing.  One pass counts."""
    names = [c for c in df.columns if c not in keep]
    clean = df.select(*keep, *[F.when(~missing(F.col(c).cast("string")), F.col(c)).alias(c) for c in names])
    counts = clean.agg(*[F.count(c).alias(c) for c in names]).first()
    return clean.select(*keep, *[c for c in names if counts[c]])


def precedence(samples: DataFrame, study: DataFrame, on: str, missing=no_term) -> DataFrame:
    """samples with the study's value where their own is missing, and the columns only the study has."""
    shared = [c for c in study.columns if c != on and c in samples.columns]
    more = [c for c in study.columns if c != on and c not in samples.columns]
    joined = samples.join(study.select(F.col(on), *[F.col(c).alias(f"__s_{c}") for c in shared], *more), on, "left")
    own = [F.when(missing(F.col(c).cast("string")), F.col(f"__s_{c}")).otherwise(F.col(c)).alias(c) if c in shared else F.col(c) for c in samples.columns]
    return joined.select(*own, *more)


def run_counts(runs: DataFrame, by: str, run: str, count: str, runs_listed: list[int]) -> DataFrame:
    """by, run<k> with each repeat's count (null where it failed), n_runs, last count."""
    wide = runs.groupBy(by).pivot(run, runs_listed).agg(F.max(count))
    named = wide.select(by, *[F.col(str(k)).alias(f"run{k}") for k in runs_listed])
    done = F.filter(F.array(*[F.col(f"run{k}") for k in runs_listed]), lambda x: x.isNotNull())
    return named.withColumn("n_runs", F.size(done).cast("bigint")).withColumn("last", F.try_element_at(done, F.lit(-1)))


def totals(metrics: DataFrame, by: list[str], counters: tuple[str, ...]) -> DataFrame:
    """Counters added up over studies; a study without a block adds nothing."""
    return metrics.groupBy(*by).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counters])


def joined_in_order(df: DataFrame, by: str, value: str, order: str, sep: str = "; ") -> DataFrame:
    """by, names: the distinct values of a group in the order in which each is first seen."""
    first = df.groupBy(by, value).agg(F.min(order).alias("at"))
    listed = F.array_sort(F.collect_list(F.struct("at", F.col(value).alias("v"))))  # distinct values of a group
    return first.groupBy(by).agg(F.array_join(F.transform(listed, lambda x: x["v"]), sep).alias("names"))


def long_to_wide(df: DataFrame, by: list[str], field: str, value: str, order: str, fields: list[str]) -> DataFrame:
    """A row a group and a column for each listed field: the value that comes first in order, null where there is none."""
    return df.groupBy(*by).pivot(field, fields).agg(F.min_by(value, order))


def usage(df: DataFrame, by: list[str], counters: list[str]) -> DataFrame:
    """Counters added up, null as 0, and the number of calls."""
    return df.groupBy(*by).agg(F.count("*").alias("n"), *[F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in counters])


def eligible(rows: DataFrame, study: str, publication: str, order: str, most: int | None = None, least_rows: int = 1) -> DataFrame:
    """(study, publication, n_samples): studies of one publication number and enough rows, the first `most` of the given order.

    A number counts in its whole-number spelling; rows without one count as samples of a study that has one.
    """
    number = F.when(~no_publication(F.col(publication)), whole_id(F.col(publication)))
    grouped = rows.groupBy(F.col(study).alias("study")).agg(
        F.countDistinct(number).alias("k"), F.min(number).alias("publication"), F.count("*").alias("n_samples"), F.min(order).alias("at")
    )
    fit = grouped.where((F.col("k") == 1) & (F.col("n_samples") >= least_rows))
    return (fit if most is None else fit.orderBy("at").limit(most)).select("study", "publication", "n_samples")


def tasks(*lists: tuple[str, list]) -> Column:
    """An array of all combinations of literal lists, to inline over a table: runs to make of each study."""
    combos: list[tuple] = [()]
    for _, items in lists:
        combos = [(*c, x) for c in combos for x in items]
    names = [n for n, _ in lists]
    return F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, c)]) for c in combos])


def short_headers(headers: list[str], longest: int = HEADER_LENGTH) -> list[str]:
    """Headers on one line, cut to a length, repeats marked #2, #3, ..."""
    seen: dict[str, int] = {}
    out = []
    for h in headers:
        name = " ".join(h.split())[:longest]
        seen[name] = seen.get(name, 0) + 1
        out.append(name if seen[name] == 1 else f"{name}#{seen[name]}")
    return out


def without_open_enums(schema: Schema) -> Schema:
    """The schema with every enum that lists nothing to choose from as plain text."""
    return Schema(tuple(dataclasses.replace(f, type="string") if f.type == "enum" and not f.allowed_values else f for f in schema.fields), schema.name)


def inside(box: tuple[Column, Column, Column, Column], x0: Column, top: Column, x1: Column, bottom: Column) -> Column:
    """Whether the centre of an object lies in a box (x0, top, x1, bottom)."""
    x, y = (x0 + x1) / 2, (top + bottom) / 2
    return x.between(box[0], box[2]) & y.between(box[1], box[3])


def ranked(relevance: DataFrame, ordinal: str = "table_id") -> DataFrame:
    """Tables by falling relevance, ties in their own order."""
    return relevance.orderBy(F.desc("score"), ordinal)
