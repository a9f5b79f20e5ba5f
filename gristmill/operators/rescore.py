"""Rescoring of values through crosswalks from labels to codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.strings import codes, parts, spaced


def crosswalk(rows: DataFrame, corpus: DataFrame) -> DataFrame:
    """(label, code) of crosswalk rows (query, match, code, order): an empty code is taken from corpus (label, code, order).

    Of rows with one label the last counts.  Rows without any code go.
    """
    known = corpus.groupBy(spaced(F.col("label")).alias("match")).agg(F.max_by("code", "order").alias("of_corpus"))
    named = rows.select(spaced(F.col("query")).alias("label"), spaced(F.col("match")).alias("match"), "code", "order")
    filled = named.join(known, "match", "left").withColumn("code", F.coalesce(F.when(F.col("code") != "", F.col("code")), F.col("of_corpus")))
    return filled.where("code IS NOT NULL").groupBy("label").agg(F.max_by("code", "order").alias("code"))


def coded(rows: DataFrame, value: str, by: str, lookup: DataFrame) -> DataFrame:
    """(by, codes): the distinct codes of the parts of a value."""
    long = rows.select(by, F.explode(parts(F.col(value))).alias("part")).withColumn("label", spaced(F.col("part")))
    return long.join(lookup, "label").groupBy(by).agg(F.array_sort(F.collect_set("code")).alias("codes"))


def share(hits: Column, of: Column) -> Column:
    """hits / of, null where there is nothing to share."""
    return F.try_divide(F.count_if(hits & of), F.count_if(of))


def rescore(cells: DataFrame, lookup: DataFrame, by: str = "cell_id") -> DataFrame:
    """One row: tp, base, agree, correct.

    cells: cell_id, extracted, gold, gold_codes, matched.  base is the share of
    equal values; agree that of cells whose codes on both sides meet (or are
    equal); correct, among cells with gold codes and extracted ones, that of
    extracted codes that meet the gold codes.
    """
    e = coded(cells, "extracted", by, lookup).withColumnRenamed("codes", "ec")
    g = coded(cells, "gold", by, lookup).withColumnRenamed("codes", "gc")
    none = F.array().cast("array<string>")
    j = cells.join(e, by, "left").join(g, by, "left").withColumns({"ec": F.coalesce("ec", none), "gc": F.coalesce("gc", none), "gi": codes(F.col("gold_codes"))})
    able = (F.size("gi") > 0) & (F.size("ec") > 0)
    return j.agg(
        F.count("*").alias("tp"),
        share(F.col("matched"), F.lit(True)).alias("base"),
        share(F.col("matched") | F.arrays_overlap("ec", "gc"), F.lit(True)).alias("agree"),
        share(F.arrays_overlap("ec", "gi"), able).alias("correct"),
        F.count_if(able).alias("n_coded"),
    )
