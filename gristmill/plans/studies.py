"""Queries over the tables of many studies at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import runs, study_joins
from .queries import _map, _t, query

_OTHER = "(o_orderkey % 7 <> 0 OR o_custkey % 3 = 0)"


def _study_tables(spark, d) -> DataFrame:
    """Three tables for each customer: orders, most of them again with another status, and notes on priorities."""
    o = _t(spark, d, "orders")
    study = F.concat(F.lit("c"), F.col("o_custkey").cast("string"))
    place = [study.alias("study"), F.col("o_orderkey").alias("row_idx")]
    odd = F.col("o_custkey") % 2 == 1
    plain = {"sample_id": F.col("o_orderkey"), "status": F.col("o_orderstatus")}
    orders = o.select(*place, F.lit("orders").alias("table_id"), F.lit(0).alias("rank"), F.when(odd, _map(**plain, subject_id=F.col("o_orderpriority"))).otherwise(_map(**plain)).alias("values"))
    status = F.when(F.col("o_orderkey") % 4 == 0, "X").otherwise(F.col("o_orderstatus"))
    again = o.where(_OTHER).select(*place, F.lit("again").alias("table_id"), F.lit(1).alias("rank"), _map(sample_id=F.col("o_orderkey"), status=status, price=F.col("o_totalprice")).alias("values"))
    notes = o.select(*place, F.lit("notes").alias("table_id"), F.lit(2).alias("rank"), _map(subject_id=F.col("o_orderpriority"), note=F.concat(F.lit("from "), F.col("o_orderkey").cast("string"))).alias("values"))
    return orders.unionByName(again).unionByName(notes)


_GATES = f"""
g AS (SELECT o_custkey, count(*) AS n, count(*) FILTER ({_OTHER}) AS s, count(DISTINCT o_orderpriority) AS p FROM orders GROUP BY o_custkey)"""


@query(f"""
WITH {_GATES}
SELECT 'c' || o_custkey AS study, 'orders' AS table_id, NULL AS key, NULL::DOUBLE AS overlap, false AS joined, NULL AS reason FROM g
UNION ALL SELECT 'c' || o_custkey, 'again', 'sample_id', s / n::DOUBLE, s / n::DOUBLE >= 0.9, CASE WHEN s / n::DOUBLE < 0.9 THEN 'overlap below the threshold' END FROM g WHERE s > 0
UNION ALL SELECT 'c' || o_custkey, 'notes', CASE WHEN o_custkey % 2 = 1 THEN 'subject_id' END, CASE WHEN o_custkey % 2 = 1 THEN 1.0 END, o_custkey % 2 = 1, CASE WHEN o_custkey % 2 = 0 THEN 'no shared key' END FROM g""")
def study_gates(spark, d):
    return study_joins.gates(_study_tables(spark, d)).select("study", "table_id", "key", "overlap", "joined", "reason")


@query(f"""
WITH {_GATES},
f AS (SELECT o_custkey, o_orderpriority, min(o_orderkey) AS first FROM orders GROUP BY ALL)
SELECT 'c' || o.o_custkey AS study, o_orderkey AS row_idx, o_orderstatus AS status, CASE WHEN s / n::DOUBLE >= 0.9 AND {_OTHER.replace('o_custkey', 'o.o_custkey')} THEN o_totalprice::VARCHAR END AS price,
       CASE WHEN o.o_custkey % 2 = 1 THEN 'from ' || first END AS note,
       CASE WHEN s / n::DOUBLE >= 0.9 AND {_OTHER.replace('o_custkey', 'o.o_custkey')} AND o_orderkey % 4 = 0 AND o_orderstatus <> 'X' THEN 'X' END AS conflict
FROM orders o JOIN g ON g.o_custkey = o.o_custkey JOIN f ON f.o_custkey = o.o_custkey AND f.o_orderpriority = o.o_orderpriority""")
def studies_joined(spark, d):
    rows, _ = study_joins.join_studies(_study_tables(spark, d))
    return rows.select("study", "row_idx", *[F.try_element_at("values", F.lit(c)).alias(c) for c in ("status", "price", "note")], F.try_element_at("conflicts", F.lit("status")).alias("conflict"))


_LINE = """CASE event_type WHEN 'click' THEN 'cmd: extract ' || event_id WHEN 'view' THEN '[fetched src' || event_id % 3 || ' for u' || user_id || ']'
  WHEN 'error' THEN 'status: FAIL rc=' || event_id % 4 WHEN 'signup' THEN 'status: ok' ELSE 'elapsed_s: ' || value END"""
_ATTEMPTS = f"""
l AS (SELECT user_id AS study, event_id % 3 + 1 AS run, event_id AS pos, {_LINE} AS line FROM events),
n AS (SELECT *, sum((line LIKE 'cmd: %')::INT) OVER (PARTITION BY study, run ORDER BY pos) AS attempt FROM l),
a AS (SELECT study, run, attempt::BIGINT AS attempt, min(pos) AS started, arg_min(line[9:], pos) FILTER (line LIKE 'status: %') AS status,
        arg_min(TRY_CAST(line[12:] AS DOUBLE), pos) FILTER (line LIKE 'elapsed_s: %') AS elapsed_s, coalesce(arg_min(regexp_extract(line, 'fetched (\\w+)', 1), pos) FILTER (line LIKE '[fetched%'), '?') AS source
      FROM n GROUP BY study, run, attempt)"""


def _log_lines(spark, d) -> DataFrame:
    e = _t(spark, d, "events")
    text = {
        "click": F.concat(F.lit("cmd: extract "), F.col("event_id").cast("string")), "error": F.concat(F.lit("status: FAIL rc="), (F.col("event_id") % 4).cast("string")), "signup": F.lit("status: ok"),
        "view": F.concat(F.lit("[fetched src"), (F.col("event_id") % 3).cast("string"), F.lit(" for u"), F.col("user_id").cast("string"), F.lit("]")), "purchase": F.concat(F.lit("elapsed_s: "), F.col("value").cast("string")),
    }
    line = F.coalesce(*[F.when(F.col("event_type") == k, v) for k, v in text.items()])
    return e.select(F.col("user_id").alias("study"), (F.col("event_id") % 3 + 1).alias("run"), F.col("event_id").alias("at"), line.alias("line"))


@query(f"WITH {_ATTEMPTS} SELECT * FROM a")
def run_attempts(spark, d):
    return runs.attempts(_log_lines(spark, d))


@query(f"""
WITH {_ATTEMPTS},
t AS (SELECT study, run, arg_max(source, attempt) AS source FROM a GROUP BY ALL),
r AS (SELECT o_custkey AS study, o_orderkey % 3 + 1 AS run, count(*) AS n FROM orders GROUP BY ALL),
g AS (SELECT o_custkey AS study, arg_max(c, run) AS gold FROM (SELECT o_custkey, o_orderkey % 3 + 1 AS run, count(DISTINCT o_orderpriority) AS c FROM orders GROUP BY ALL) GROUP BY o_custkey),
k AS (SELECT coalesce(t.study, r.study) AS study, coalesce(t.run, r.run) AS run, n, coalesce(source, '?') AS source FROM t FULL JOIN r ON t.study = r.study AND t.run = r.run)
SELECT k.study, {", ".join(f"max(n) FILTER (run = {i}) AS run{i}, CASE WHEN max(n) FILTER (run = {i}) IS NULL THEN 'fail' ELSE 'ok' END AS status{i}, coalesce(max(source) FILTER (run = {i}), '?') AS source{i}" for i in (1, 2, 3))}, any_value(gold) AS gold
FROM k LEFT JOIN g ON g.study = k.study GROUP BY k.study""")
def run_ledger(spark, d):
    """Runs of events as logs, and of orders as what they gave."""
    o = _t(spark, d, "orders").select(F.col("o_custkey").alias("study"), (F.col("o_orderkey") % 3 + 1).alias("run"), "o_orderpriority")
    found = o.groupBy("study", "run").agg(F.count("*").alias("n_samples"), F.countDistinct("o_orderpriority").alias("n_gold"))
    return runs.ledger(found, runs.attempts(_log_lines(spark, d)), found, [1, 2, 3])
