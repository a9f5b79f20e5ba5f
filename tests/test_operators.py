import pytest
from pyspark.sql import functions as F

from gristmill.operators import accessions, evaluate, joins, mapping, profile, records, rescore
from gristmill.sources.schema import Field, Schema


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()] if order else [tuple(r) for r in df.collect()]


def test_cells_inherit_study_values_unless_the_sample_has_the_key(spark):
    e = spark.createDataFrame([("s", 0, {"sex": ""}), ("s", 1, {"age": "5"})], "study string, row_idx long, values map<string,string>")
    g = spark.createDataFrame([("s", 0, {"sex": "f", "age": "5"}), ("s", 1, {"sex": "f", "age": "6"}), ("s", 2, {"sex": "f"})], "study string, row_idx long, values map<string,string>")
    f = spark.createDataFrame([("s", "sex", "F", "inferred", "low")], "study string, field string, value string, extraction_type string, confidence string")
    cells = evaluate.cells(e, g, {"sex": "sex", "age": "age"}, f)
    assert rows(cells.select("sample_idx", "field", "decision"), "sample_idx", "field") == [(0, "age", "FN"), (0, "sex", "FN"), (1, "age", "TP_wrong"), (1, "sex", "TP_correct")]
    wide = evaluate.cells(e, g, {"sex": "sex", "age": "age"}, f, missing_gold_as_fn=True).where("sample_idx = 2")
    assert rows(wide.select("field", "extracted", "decision"), "field") == [("age", None, "TN"), ("sex", None, "FN")]
    by = {r.field: r for r in evaluate.metrics_by_field(cells, ["sex", "age", "never"]).collect()}
    assert by["never"].n == 0 and by["never"].precision is None and by["sex"].recall == 0.5
    assert {(r.stratum, r.label, r.n) for r in evaluate.strata(cells).collect()} == {("extraction_type", "inferred", 2), ("confidence", "low", 2)}


def test_strict_ratios_differ_at_zero(spark):
    df = spark.createDataFrame([(0, 0, 0, 3, 2)], "tn long, tp_correct long, tp_wrong long, fn long, fp long")
    assert evaluate.strict_ratios(df).first().f1 is None and evaluate.ratios(df).first().f1 is None


def test_alignment_takes_the_first_extracted_record(spark):
    kind = "study string, row_idx long, values map<string,string>"
    e = spark.createDataFrame([("s", 0, {"a": "R1; x", "v": "first"}), ("s", 1, {"a": "R1", "v": "second"}), ("s", 2, {"a": "NA"})], kind)
    g = spark.createDataFrame([("s", 0, {"a": "R9"}), ("s", 1, {"a": "R1"})], kind)
    left, right = evaluate.align(e, g, "a")
    assert rows(left.select("row_idx", F.col("values")["v"])) == [(1, "first")] and right.count() == 1


def test_join_keeps_left_rows_and_notes_conflicts(spark):
    left = spark.createDataFrame([(0, "a", "1", ""), (1, "b", "2", "x"), (2, "", "3", "y")], "row_idx long, sample_id string, age string, site string")
    right = spark.createDataFrame([(0, "a", "9", "gut"), (1, "a", "8", "skin"), (2, "b", "2", "z"), (3, "", "7", "q")], "row_idx long, sample_id string, age string, site string")
    out, log = joins.join_tables([("l", left), ("r", right)])
    assert rows(out.select("row_idx", "age", "site", joins.CONFLICTS), "row_idx") == [(0, "1", "gut", {"age": "9"}), (1, "2", "x", {"site": "z"}), (2, "3", "y", {})]
    assert log.anchor == "l" and log.joined[0]["key"] == "sample_id" and not log.skipped


def test_join_gate_and_missing_keys(spark):
    left = spark.createDataFrame([(i, str(i)) for i in range(10)], "row_idx long, sample_id string")
    few = spark.createDataFrame([(0, "1", "x")], "row_idx long, sample_id string, extra string")
    none = spark.createDataFrame([(0, "x")], "row_idx long, other string")
    out, log = joins.join_tables([("l", left), ("few", few), ("none", none)])
    assert out.count() == 10 and "extra" not in out.columns and [s["right"] for s in log.skipped] == ["few", "none"]
    assert joins.join_tables([("l", left)])[0].count() == 10


def test_a_blank_key_filled_by_one_table_finds_the_next(spark):
    base = spark.createDataFrame([(0, "a", "")], "row_idx long, sample_id string, subject_id string")
    second = spark.createDataFrame([(0, "a", "p")], "row_idx long, sample_id string, subject_id string")
    out = joins.merge_right(base, second, "sample_id")
    third = spark.createDataFrame([(0, "p", "42")], "row_idx long, subject_id string, age string")
    assert joins.merge_right(out, third, "subject_id").first().age == "42"


def test_later_conflicts_win(spark):
    base = spark.createDataFrame([(0, "a", "1")], "row_idx long, k string, v string")
    others = [spark.createDataFrame([(0, "a", v)], "row_idx long, k string, v string") for v in ("2", "3")]
    out = joins.merge_right(joins.merge_right(base, others[0], "k"), others[1], "k")
    assert out.first()[joins.CONFLICTS] == {"v": "3"}


def test_unions_and_fallbacks(spark):
    a, b = spark.createDataFrame([("x", "1")], "k string, a string"), spark.createDataFrame([("y", "2")], "k string, b string")
    assert rows(joins.union_columns([a, b]), "k") == [("x", "1", ""), ("y", "", "2")]
    assert rows(joins.fallback(a, spark.createDataFrame([("x", "no"), ("z", "yes")], "k string, a string"), "k"), "k") == [("x", "1"), ("z", "yes")]


def test_header_tiers():
    m = mapping.map_headers(["Sample_ID", "body site", "Gender", "sex", "colour", "Sampel_id"], ["sample_id", "body_site", "sex"])
    assert m.tier == {"Sample_ID": "exact", "body site": "normalized", "Gender": "alias"}
    assert m.unmapped == ["sex", "colour", "Sampel_id"] and m.collisions == [("sex", "sex")]
    fuzzy = mapping.map_headers(["diseases"], ["disease"], fuzzy=True)
    assert fuzzy.mapped == {"diseases": "disease"} and mapping.ratio("disease", "diseases") == pytest.approx(93.333, abs=0.01)
    assert mapping.map_headers(["run"], ["runs"], fuzzy=True).unmapped == ["run"]  # its alias is no field
    assert not mapping.map_headers([], ["a"]).mapped and mapping.map_headers(["a"], []).unmapped == ["a"]


def test_rename_lets_the_last_column_win(spark):
    df = spark.createDataFrame([("1", "2")], "Gender string, sex string")
    assert rows(mapping.rename(df, mapping.Mapping({"Gender": "sex"}))) == [("2",)]


TOY = Schema((Field("sample_id", "", "string"), Field("age", "", "number"), Field("sex", "", "enum", ("male", "female")), Field("body_site", "", "enum", ("stool", "skin", "oral"))))


def table(spark, name, header, body):
    grid = [(name, i, row) for i, row in enumerate([header, *body])]
    cells = [(name, i, j, header[j], v) for i, row in enumerate(body) for j, v in enumerate(row)]
    return spark.createDataFrame(cells, "table_id string, row_idx long, col_idx int, col string, value string"), spark.createDataFrame(grid, "table_id string, row_idx long, cells array<string>")


def test_relevance(spark):
    good = table(spark, "good", ["sample_id", "age", "Gender", "body_site"], [[f"s{i}", str(20 + i), ["Male", "female"][i % 2], "stool"] for i in range(5)])
    genes = table(spark, "genes", ["gene", "ctl", "trt", "ko", "wt", "mut"], [[f"g{i}", *["0.1"] * 5] for i in range(8)])
    taxa = table(spark, "taxa", ["feature", "s1", "s2", "s3"], [[f"k__B|p__F{i}", "0.1", "0.2", "0"] for i in range(10)])
    turned = table(spark, "turned", ["field", *[f"S-{i}" for i in range(10)]], [["sex", *["m"] * 10], ["age", *["1"] * 10]])
    block = table(spark, "block", ["statistic", "value"], [["mean", "3"]])
    cells, grid = (a.unionByName(b).unionByName(c).unionByName(d).unionByName(e) for a, b, c, d, e in zip(good, genes, taxa, turned, block))
    got = {r.table_id: r for r in profile.relevance(cells, TOY, grid).collect()}
    assert got["good"].matched_fields == {"age": "age", "body_site": "body_site", "sample_id": "sample_id", "sex": "Gender"}
    assert got["good"].score == pytest.approx(0.2 * 5 / 8 + 0.2 + 0.25 * 2 / 4 + 0.35 * 2 / 4)
    assert [got[k].is_matrix for k in ("good", "genes", "taxa", "turned", "block")] == [False, True, True, True, False]
    assert got["genes"].score == 0 and got["block"].score < profile.GATE


def test_batches_keep_the_earliest_value(spark):
    v = spark.createDataFrame([("a", 0, "x", "1"), ("a", 1, "x", "2"), ("a", 1, "y", "3"), ("zz", 0, "x", "9")], "sample_id string, batch int, field string, value string")
    ids = spark.createDataFrame([("a",), ("b",)], "sample_id string")
    assert rows(records.merge_batches(v, ids).select("sample_id", "field", "value"), "sample_id", "field") == [("a", "x", "1"), ("a", "y", "3"), ("b", None, None)]
    assert rows(records.merge_warnings(v, ids), "batch", "kind") == [(0, "unknown sample_id", 1), (1, "kept earlier value", 1)]


def test_fan_out_prefers_sample_then_subgroup_then_study(spark):
    s = spark.createDataFrame([("p", 0, {"type": "Mother", "sex": "Not reported"}), ("p", 1, {"type": "x", "sex": "m"})], "study string, row_idx long, values map<string,string>")
    f = spark.createDataFrame([("p", "sex", "study", {"mothers": "female"}), ("p", "note", "not_reported", None)], "study string, field string, value string, by_subgroup map<string,string>")
    g = spark.createDataFrame([("p", ["mothers", "infants"])], "study string, subgroups array<string>")
    got = rows(records.fan_out(s, f, g).select("row_idx", F.col("values")["sex"], "n_written"), "row_idx")
    assert got == [(0, "female", 1), (1, "m", 0)]


def test_bounded_ages_fill_maps(spark):
    s = spark.createDataFrame([(0, {"age_group": "Adult"}), (1, {"age": "3"})], "row_idx long, values map<string,string>")
    got = rows(records.bounded_ages(s).select(F.col("values")["age_min"], F.col("values")["age_max"], "n_written"), "row_idx")
    assert got == [("18", "65", 2), ("3", "3", 2)]


def test_accessions_in_context(spark):
    text = "Data are available under accession PRJNA11. " + "x" * 600 + " compared with PRJEB22 and SRR1234567, PRJNA11."
    found = {r.value: r for r in accessions.mine(spark.createDataFrame([(1, text), (2, "none")], "id int, t string"), "id", "t").collect()}
    assert found["PRJNA11"].n == 2 and found["PRJNA11"].context_score >= 3 and found["PRJEB22"].context_score == 0 and found["SRR1234567"].kind == "run"


def test_own_project_rules(spark):
    a = [(1, "bioproject", "A", 2, 1), (1, "bioproject", "B", 1, 1), (2, "bioproject", "C", 0, 1), (3, "bioproject", "D", 0, 1), (3, "bioproject", "E", 0, 1), (4, "run", "R", 1, 1), (5, "run", "S", 0, 9)]
    df = spark.createDataFrame(a, "id int, kind string, value string, context_score long, n long")
    known = spark.createDataFrame([("R", "P1"), ("R", "P2"), ("S", "P3")], "value string, project string")
    assert rows(accessions.own_projects(df, "id", known), "id", "project") == [(1, "A", 1), (2, "C", 2), (4, "P1", 3), (4, "P2", 3)]


def test_ladder_and_best_candidate(spark):
    c = spark.createDataFrame([("p", 0, 3.0, False), ("p", 1, 1.0, True), ("p", 2, 1.6, True), ("p", 3, 9.0, True)], "k string, rung int, score double, is_body boolean")
    seen = accessions.ladder(c, "k", 1.5)
    assert rows(seen.select("rung"), "rung") == [(0,), (1,), (2,)] and accessions.best_candidate(seen, "k").first().rung == 2


def test_rescoring(spark):
    rows_ = spark.createDataFrame([("T2D", "type 2 diabetes", "", 0), ("crc", "x", "C:1", 1), ("crc", "x", "C:2", 2)], "query string, match string, code string, order int")
    corpus = spark.createDataFrame([("Type 2  Diabetes", "M:1", 0)], "label string, code string, order int")
    look = rescore.crosswalk(rows_, corpus)
    assert rows(look, "label") == [("crc", "C:2"), ("t2d", "M:1")]
    cells = spark.createDataFrame([(0, "T2D; crc", "crc", "C:2", False), (1, "a", "a", "NA", True), (2, "crc", "b", "X:1", False)], "cell_id int, extracted string, gold string, gold_codes string, matched boolean")
    r = rescore.rescore(cells, look).first()
    assert (r.tp, r.base, r.agree, r.correct, r.n_coded) == (3, pytest.approx(1 / 3), pytest.approx(2 / 3), 0.5, 2)
