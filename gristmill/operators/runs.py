"""Logs of runs: attempts, and the ledger of repeats by study."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: How log lines of a run begin, and what names the source of a text.
START = r"^cmd: "
STATUS = r"^status: (.*)$"
ELAPSED = r"^elapsed_s: ([0-9.]+)"
SOURCE = r"fetched (\w+)"
#: Lines of a log that one task numbers.
SPAN_LINES = 1 << 16


def attempts(lines: DataFrame) -> DataFrame:
    """(study, run, attempt, started, status, elapsed_s, source) of log lines (study, run, at, line).

    An attempt begins at a line with a command; lines before the first one
    belong to attempt 0.  Status is `ok`, `FAIL ...` or `TIMEOUT...`, null where
    the log ends before it; source is `?` where no text was fetched.  Commands
    are counted by spans of `at` first, so a long log is many tasks' work.
    """
    begins = F.col("line").rlike(START).cast("int")
    placed = lines.withColumns({"begins": F.coalesce(begins, F.lit(0)), "span": F.floor(F.col("at") / SPAN_LINES)})
    spans = placed.groupBy("study", "run", "span").agg(F.sum("begins").alias("n"))
    before = Window.partitionBy("study", "run").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    bases = spans.select("study", "run", "span", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("study", "run", "span").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    numbered = placed.join(bases, ["study", "run", "span"]).withColumn("attempt", F.col("base") + F.sum("begins").over(inside))

    def found(pattern: str):
        return F.when(F.col("line").rlike(pattern), F.regexp_extract("line", pattern, 1))

    out = numbered.groupBy("study", "run", "attempt").agg(
        F.min("at").alias("started"), F.min_by(found(STATUS), F.when(F.col("line").rlike(STATUS), F.col("at"))).alias("status"),
        F.min_by(found(ELAPSED), F.when(F.col("line").rlike(ELAPSED), F.col("at"))).cast("double").alias("elapsed_s"),
        F.coalesce(F.min_by(found(SOURCE), F.when(F.col("line").rlike(SOURCE), F.col("at"))), F.lit("?")).alias("source"),
    )
    return out


def last_attempts(tried: DataFrame) -> DataFrame:
    """Of each study's runs the last attempt, with the number of attempts as n_attempts."""
    rest = [c for c in tried.columns if c not in ("study", "run", "attempt")]
    last = tried.groupBy("study", "run").agg(F.max_by(F.struct(*rest), "attempt").alias("x"), F.count_if(F.col("attempt") > 0).alias("n_attempts"))
    return last.select("study", "run", *[f"x.{c}" for c in rest], "n_attempts")


def ledger(results: DataFrame, tried: DataFrame, golds: DataFrame, runs: list[int]) -> DataFrame:
    """A row a study: gold, and for each of the runs its count of samples, status and source.

    results: (study, run, n_samples) of runs that gave a result; a run without
    one has a null count and status `fail`.  golds: (study, run, n_gold); the
    last run's number counts.  Columns are run<k>, status<k>, source<k>.
    """
    last = last_attempts(tried).select("study", "run", "source")
    both = results.select("study", "run", "n_samples").join(last, ["study", "run"], "full")
    cells = F.struct(F.col("n_samples").alias("run"), F.when(F.col("n_samples").isNull(), "fail").otherwise("ok").alias("status"), F.coalesce("source", F.lit("?")).alias("source"))
    wide = both.groupBy("study").pivot("run", runs).agg(F.first(cells))
    given = {}
    for k in runs:
        given |= {f"run{k}": F.col(f"`{k}`.run"), f"status{k}": F.coalesce(F.col(f"`{k}`.status"), F.lit("fail")), f"source{k}": F.coalesce(F.col(f"`{k}`.source"), F.lit("?"))}
    gold = golds.groupBy("study").agg(F.max_by("n_gold", "run").alias("gold"))
    return wide.select("study", *[c.alias(n) for n, c in given.items()]).join(gold, "study", "left")
