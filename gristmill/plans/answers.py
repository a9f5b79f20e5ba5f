"""Queries of typed values: stored answers with lists, numbers and booleans, to records, cells, CSV and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import sinks
from ..engine import Engine
from ..operators import evaluate
from ..operators.records import AGE_NOTE
from ..shared import scratch, written
from ..sinks import sample_rows
from ..sources import results
from . import table_plan
from .queries import _map, _t, query


def _part_answers(spark, d) -> DataFrame:
    """A stored answer for each part: a sample with a list, a boolean and numbers, and study fields with lists."""
    k = F.col("p_partkey")
    words = F.split("p_name", " ")
    tags = F.when(k % 2 == 0, F.array("p_brand", "p_type")).otherwise(F.array("p_type", "p_brand"))
    sample = F.struct(
        F.concat(F.lit("p"), k.cast("string")).alias("sample_id"), tags.alias("tags"), (k % 4 != 0).alias("in_stock"), F.col("p_retailprice").alias("price"),
        F.when(k % 5 == 0, F.array().cast("array<string>")).when(k % 5 == 1, F.array(F.lit("mine"))).alias("words"),
        F.when(k % 3 == 1, k % 80).alias("age"), F.when(k % 3 == 2, k % 80 + 0.5).alias("age_years"),
    )

    def field(value: F.Column, notes: F.Column | None = None) -> F.Column:
        given = {"value": value, "extraction_type": F.lit("derived"), "confidence": F.lit("high"), "evidence_quote": F.lit("q"), "section": F.lit("s")}
        return F.struct(*[c.alias(n) for n, c in given.items()], *([notes.alias("notes")] if notes is not None else []))

    fields = F.struct(
        field(words).alias("words"), field(F.array(words)).alias("nested"), field(F.when(k % 3 == 0, "Adult").otherwise("Unknown")).alias("age_group"),
        field(F.lit("not reported"), F.when(k % 2 == 0, "n")).alias("age_min"),
    )
    whole = F.struct(
        F.lit("sample_level").alias("granularity"), F.array().cast("array<string>").alias("subgroups"), fields.alias("fields"), F.array(sample).alias("samples"),
        F.struct(k.alias("kept")).alias("extra"),
    )
    raw = F.concat(F.lit("Here it is:\n```json\n"), F.to_json(whole), F.lit("\n```"))
    return _t(spark, d, "part").select(k.cast("string").alias("paper_id"), F.lit(0).alias("batch_idx"), raw.alias("raw"))


_TAGS = "CASE WHEN p_partkey % 2 = 0 THEN [p_brand, p_type] ELSE [p_type, p_brand] END"
_AGE = "CASE p_partkey % 3 WHEN 1 THEN (p_partkey % 80)::VARCHAR WHEN 2 THEN (p_partkey % 80)::VARCHAR || '.5' END"


@query(f"""
SELECT p_partkey::VARCHAR AS paper_id, 'p' || p_partkey AS sample_id, array_to_string({_TAGS}, '; ') AS tags, CASE WHEN p_partkey % 4 <> 0 THEN 'True' ELSE 'False' END AS in_stock,
       p_retailprice::DOUBLE::VARCHAR AS price, CASE WHEN p_partkey % 5 = 1 THEN 'mine' ELSE replace(p_name, ' ', '; ') END AS words,
       '[''' || replace(p_name, ' ', ''', ''') || ''']' AS nested, coalesce({_AGE}, '18') AS age_min, coalesce({_AGE}, '65') AS age_max FROM part""")
def typed_csv(spark, d):
    samples, _ = Engine(spark).records(_part_answers(spark, d))
    return sample_rows(samples.withColumnRenamed("study", "paper_id"), columns=["sample_id", "tags", "in_stock", "price", "words", "nested", "age_min", "age_max"])


@query(f"""
WITH p AS (SELECT *, {_TAGS} AS tags FROM part),
c AS (SELECT p_partkey::VARCHAR AS study, 'tags' AS field, '[''' || array_to_string(tags, ''', ''') || ''']' AS extracted,
        CASE p_partkey % 3 WHEN 0 THEN 'TP_correct' WHEN 1 THEN 'TP_wrong' ELSE 'FP' END AS decision FROM p
      UNION ALL SELECT p_partkey::VARCHAR, 'in_stock', CASE WHEN p_partkey % 4 <> 0 THEN 'True' ELSE 'False' END, CASE WHEN p_partkey % 4 <> 0 THEN 'TP_correct' ELSE 'TP_wrong' END FROM p
      UNION ALL SELECT p_partkey::VARCHAR, 'price', p_retailprice::DOUBLE::VARCHAR, CASE WHEN p_partkey % 2 = 0 THEN 'TP_correct' ELSE 'TP_wrong' END FROM p
      UNION ALL SELECT p_partkey::VARCHAR, 'words', CASE p_partkey % 5 WHEN 1 THEN '[''mine'']' WHEN 0 THEN '[]' ELSE '[''' || replace(p_name, ' ', ''', ''') || ''']' END,
        CASE p_partkey % 5 WHEN 0 THEN 'FN' WHEN 1 THEN 'TP_wrong' ELSE 'TP_correct' END FROM p)
SELECT * FROM c""")
def typed_cells(spark, d):
    """Answers as they stand, before study values are handed down, against gold text."""
    k = F.col("p_partkey")
    ordered = F.array_join(F.array_sort(F.array(F.lower("p_brand"), F.lower("p_type"))), ", ")
    tags = F.when(k % 3 == 0, ordered).when(k % 3 == 1, F.concat_ws("; ", "p_brand", "p_type")).otherwise(" n/a")
    price = F.col("p_retailprice") * F.when(k % 2 == 0, 1.04).otherwise(1.06)
    words = F.array_join(F.array_sort(F.split("p_name", " ")), ", ")
    gold = _t(spark, d, "part").select(k.cast("string").alias("study"), F.lit(0).cast("long").alias("row_idx"), _map(tags=tags, in_stock=F.lit("1"), price=price, words=words).alias("values"))
    seen = results.parsed(_part_answers(spark, d))
    fields = results.first_fields(results.field_rows(seen))
    names = ["tags", "in_stock", "price", "words"]
    return evaluate.cells(results.sample_rows(seen), gold, evaluate.field_map(names, names), fields).select("study", "field", "extracted", "decision")


@query(f"""
WITH s AS (SELECT p_partkey::VARCHAR AS study, 'sample' AS level, 1::BIGINT AS sample_index, 'tags' AS field, unnest({_TAGS}) AS value, NULL AS evidence FROM part
  UNION ALL SELECT p_partkey::VARCHAR, 'sample', 1, 'in_stock', CASE WHEN p_partkey % 4 <> 0 THEN 'TRUE' ELSE 'FALSE' END, NULL FROM part
  UNION ALL SELECT p_partkey::VARCHAR, 'sample', 1, 'words', 'mine', NULL FROM part WHERE p_partkey % 5 = 1
  UNION ALL SELECT p_partkey::VARCHAR, 'study', NULL, 'words', unnest(string_split(p_name, ' ')), 'q' FROM part
  UNION ALL SELECT p_partkey::VARCHAR, 'study', NULL, 'age_min', 'not reported', 'q' FROM part)
SELECT * FROM s""")
def answers_snapshot(spark, d):
    out = results.snapshot(results.parsed(_part_answers(spark, d)))
    return out.where(F.col("field").isin("tags", "in_stock", "words", "age_min")).select("study", "level", "sample_index", "field", "value", "evidence")


@query(f"""
SELECT p_partkey::VARCHAR AS paper_id, CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 2 END::BIGINT AS n_written, p_partkey::VARCHAR AS kept, {_AGE} AS low, {_AGE} AS high,
       CASE WHEN p_partkey % 3 = 0 THEN '18' ELSE 'not reported' END AS study_low,
       CASE WHEN p_partkey % 3 = 0 THEN CASE WHEN p_partkey % 2 = 0 THEN 'n ' ELSE '' END || '{AGE_NOTE}' WHEN p_partkey % 2 = 0 THEN 'n' END AS notes,
       replace(p_name, ' ', '|') AS words FROM part""")
def age_retrofit(spark, d):
    done = results.age_retrofit(_part_answers(spark, d))
    at = {"kept": "$.extra.kept", "low": "$.samples[0].age_min", "high": "$.samples[0].age_max", "study_low": "$.fields.age_min.value", "notes": "$.fields.age_min.notes"}
    words = F.array_join(F.from_json(F.get_json_object("raw", "$.fields.words.value"), "array<string>"), "|")
    return done.select("paper_id", "n_written", *[F.get_json_object("raw", path).alias(n) for n, path in at.items()], words.alias("words"))


@query(f"""
WITH g AS (SELECT p_partkey::VARCHAR AS study, * FROM part),
c AS (SELECT study, 'words' AS field, CASE p_partkey % 5 WHEN 1 THEN 'TP_wrong' ELSE 'TP_correct' END AS decision FROM g
  UNION ALL SELECT study, 'age_min', CASE WHEN p_partkey % 3 = 0 THEN CASE WHEN p_size % 2 = 0 THEN 'TP_correct' ELSE 'TP_wrong' END ELSE 'FP' END FROM g
  UNION ALL SELECT study, 'sample_id', 'TP_correct' FROM g)
SELECT field, count(*) FILTER (decision = 'TN') AS tn, count(*) FILTER (decision = 'TP_correct') AS tp_correct, count(*) FILTER (decision = 'TP_wrong') AS tp_wrong,
       count(*) FILTER (decision = 'FN') AS fn, count(*) FILTER (decision = 'FP') AS fp, count(*) FILTER (decision = 'TP_correct') / count(*) FILTER (decision LIKE 'TP%')::DOUBLE AS value_accuracy FROM c GROUP BY field""")
def whole_evaluation(spark, d):
    """Stored answers to records, against twenty gold files that are written and read back: metrics by field."""
    k = F.col("p_partkey")
    low = F.when(k % 3 == 0, F.when(F.col("p_size") % 2 == 0, "18.5").otherwise("30")).otherwise("NA")
    words = F.replace("p_name", F.lit(" "), F.lit("; "))
    gold = _t(spark, d, "part").select((k % 20).cast("string").alias("paper_id"), k.alias("at"), F.concat(F.lit("p"), k.cast("string")).alias("sample_id"), words.alias("words"), low.alias("age_min"))
    folder = scratch(spark)
    sinks.write_table_files(gold, folder, "at", ".tsv", "\t")
    samples, _ = Engine(spark).records(_part_answers(spark, d))
    part = F.col("study").cast("long")
    # written, so that records are made once for all metrics
    placed = written(samples).select((part % 20).cast("string").alias("study"), F.floor(part / 20).alias("row_idx"), "values")
    names = ["sample_id", "words", "age_min"]
    found = Engine(spark).evaluate(placed, results.read_gold(spark, folder), evaluate.field_map(names, names))
    return found["by_field"].select("field", "tn", "tp_correct", "tp_wrong", "fn", "fp", "value_accuracy")


@query("""
WITH o AS (SELECT o_custkey, o_orderkey, o_orderstatus, o_orderpriority, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders),
w AS (SELECT o_custkey, bool_or(o_orderkey % 3 = 0) AS wide, count(*) AS n FROM o WHERE i <= 20 GROUP BY o_custkey)
SELECT 'c' || o_custkey AS table_id, CASE WHEN any_value(wide) THEN 'row' || chr(9) || 'c0' || chr(9) || 'c1' ELSE 'row' || chr(9) || 'c0' END || chr(10)
  || string_agg((i - 1) || chr(9) || o_orderkey || ' ' || o_orderstatus || CASE WHEN wide THEN chr(9) || CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority ELSE '' END ELSE '' END, chr(10) ORDER BY i) AS text
FROM o JOIN w USING (o_custkey) WHERE i <= 20 GROUP BY o_custkey""")
def planner_grids(spark, d):
    """The first rows of a ragged grid for each customer, as a planner sees them."""
    o = _t(spark, d, "orders")
    first = F.concat_ws("\n", F.col("o_orderkey").cast("string"), "o_orderstatus")
    cells = F.when(F.col("o_orderkey") % 3 == 0, F.array(first, F.col("o_orderpriority"))).otherwise(F.array(first))
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    return table_plan.shown_grids(o.select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("table_id"), place.cast("long").alias("row_idx"), cells.alias("cells")))
