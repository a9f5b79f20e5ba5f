"""Variants against the same rules on Python's own values."""

import json

from pyspark.sql import functions as F

from gristmill.functions import typed, values
from gristmill.operators import evaluate, records
from gristmill.sources import results

VALUES = ['"text"', '" Not Reported "', '""', "null", "true", "false", "0", "-17", "18.0", "0.5", "1e22", "1.5e-7", "0.00025", "123456789.25", "12345678901234567890", "[]", '["b", " A"]', '["it\'s", "a \\"q\\"", "back\\\\slash"]',
          "[1, 2.5, true, null]", '[["x", 1], []]', "{}", '"12.50"', '"nan"', '["n/a"]']


def plain_cell(v):
    return "" if v is None else "; ".join(plain_cell(x) for x in v) if isinstance(v, list) else str(v)


def plain_compared(v):
    return ", ".join(sorted(str(x).strip().lower() for x in v)) if isinstance(v, list) else str(v).strip().lower()


def plain_number(v):
    try:
        return float(v)
    except (TypeError, ValueError):
        return None


def test_rules_are_those_of_plain_values(spark):
    df = spark.createDataFrame([(j,) for j in VALUES], "j string").withColumn("v", F.parse_json("j"))
    rules = [typed.text, typed.handed_down, typed.cell, typed.compared, typed.number, typed.not_scored, typed.not_fanned]
    for r in df.select("j", *[f(F.col("v")).alias(f.__name__) for f in rules]).collect():
        v = json.loads(r.j)
        scored = v is None or v == [] or isinstance(v, str) and v.strip().lower() in ("not_reported", "na", "n/a", "", "none", "null")
        fanned = v is None or v in ([], {}) or isinstance(v, str) and v.strip().lower().replace(" ", "_") in ("", "not_reported")
        down = "" if v is None else "; ".join(str(x) for x in v) if isinstance(v, list) else str(v)
        want = [str(v), down, plain_cell(v), plain_compared(v), plain_number(v), scored, fanned]
        assert [str(x) for x in r[1:]] == [str(x) for x in want], r.j


def test_lists_match_in_any_order(spark):
    df = spark.sql("""SELECT parse_json('["b", "a"]') AS e, CAST('a, b' AS VARIANT) AS g, parse_json('true') AS t, parse_json('1') AS one, CAST(NULL AS VARIANT) AS none""")
    pairs = [("e", "g"), ("g", "e"), ("t", "one"), ("e", "one"), ("none", "g"), ("e", "none"), ("none", "none")]
    got = df.select(*[values.decision(F.col(a), F.col(b), typed=True).alias(f"{a}_{b}") for a, b in pairs]).first()
    assert list(got) == ["TP_correct", "TP_correct", "TP_correct", "TP_wrong", "FN", "FP", "TN"]


def test_text_and_variants_meet(spark):
    text = spark.createDataFrame([("s", 0, {"x": "1", "y": "a, b"})], "study string, row_idx long, values map<string,string>")
    answers = spark.sql("""SELECT 's' AS study, 0L AS row_idx, from_json('{"x": 1.0, "z": []}', 'map<string,variant>') AS values""")
    fields = spark.sql("""SELECT 's' AS study, 'y' AS field, parse_json('["B", "a"]') AS value, 'derived' AS extraction_type, 'high' AS confidence, CAST(NULL AS MAP<STRING,VARIANT>) AS by_subgroup""")
    for given in (answers, answers.withColumn("values", F.transform_values("values", lambda k, v: typed.text(v)))):
        got = {r.field: (r.extracted, r.decision) for r in evaluate.cells(given, text, {"x": "x", "y": "y"}, fields).collect()}
        assert got == {"x": ("1.0", "TP_correct"), "y": ("['B', 'a']", "TP_correct")}
    filled = records.fan_out(text.withColumn("values", F.create_map(F.lit("x"), F.lit("1"))), fields).first()
    assert {k: v.toPython() for k, v in filled["values"].items()} == {"x": "1", "y": "B; a"} and filled.n_written == 1


def test_a_retrofit_keeps_what_it_does_not_know(spark):
    answer = {"odd": [1, {"k": None}], "fields": {"age_group": {"value": "Adult", "mine": 1}, "age_max": {"value": None, "notes": "n"}}, "samples": [{"age": "7", "age_max": 3}, {"age_min": "40"}, {"z": ["a"]}]}
    raw = spark.createDataFrame([("p", 0, json.dumps(answer)), ("q", 0, "no answer"), ("r", 0, '{"granularity": "x"}'), ("t", 0, None)], "paper_id string, batch_idx int, raw string")
    got = {r.paper_id: r for r in results.age_retrofit(raw).collect()}
    answer["fields"]["age_max"] = {"value": "65", "notes": f"n {records.AGE_NOTE}", "extraction_type": "derived"}
    answer["samples"][0]["age_min"] = "7"
    assert json.loads(got["p"].raw) == answer and got["p"].n_written == 2
    assert (got["q"].raw, got["q"].n_written) == ("no answer", None) and json.loads(got["r"].raw) == {"granularity": "x"} and got["r"].n_written == 0
    assert got["t"].raw is None
