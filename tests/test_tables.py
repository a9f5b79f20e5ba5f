import io
import zipfile

import pytest
from pyspark.sql import functions as F

from gristmill import sinks
from gristmill.engine import Engine
from gristmill.plans import table_plan as tp
from gristmill.sources import grid, results, schema, web


def as_grid(spark, body, name="t"):
    return spark.createDataFrame([(name, i, r) for i, r in enumerate(body)], "table_id string, row_idx long, cells array<string>")


def workbook(sheets):
    blob = io.BytesIO()
    with zipfile.ZipFile(blob, "w") as z:
        z.writestr("xl/workbook.xml", '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>' + "".join(f'<sheet name="{n}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(sheets)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="x">' + "".join(f'<Relationship Id="r{i}" Target="worksheets/s{i}.xml"/>' for i in range(len(sheets))) + "</Relationships>")
        for i, rows in enumerate(sheets.values()):
            cells = "".join(f'<row r="{r + 1}">' + "".join(f'<c r="{chr(65 + c)}{r + 1}" t="inlineStr"><is><t>{v}</t></is></c>' for c, v in enumerate(row)) + "</row>" for r, row in enumerate(rows))
            z.writestr(f"xl/worksheets/s{i}.xml", f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{cells}</sheetData></worksheet>')
    return blob.getvalue()


def test_files_become_grids(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b'sample_id,site\r\n"x\ny",gut,more\r\n\xff,\r\n')
    (tmp_path / "b.tsv").write_text("k\tv\n1\t2\n")
    (tmp_path / "c.xlsx").write_bytes(workbook({"one": [["h"], ["1"]], "two": [["g"], ["2"]]}))
    (tmp_path / "n.txt").write_text("words")
    (tmp_path / "p.png").write_bytes(b"x")
    (tmp_path / "bad.xlsx").write_bytes(b"no zip")
    parts = grid.read_files(spark, str(tmp_path))
    log = {r.name: (r.status, r.reason) for r in grid.ingest_log(parts).collect()}
    assert log["a.csv"] == ("table", None) and log["p.png"][0] == "skipped" and "BadZipFile" in log["bad.xlsx"][1]
    rows = {(r.table_id, r.row_idx): r.cells for r in grid.grids(parts).collect()}
    assert rows["a.csv", 1] == ["x\ny", "gut", "more"] and rows["a.csv", 2][0] == "�" and rows["c.xlsx::two", 1] == ["2"] and rows["b.tsv", 1] == ["1", "2"]
    assert grid.texts(parts).first().block == "--- SUPPLEMENTARY FILE: n.txt (source: local) ---\nwords"


@pytest.mark.parametrize(
    "body, columns, n",
    [
        ([["a", "", "a"], ["1", "2"], ["", " "], ["3", "4", "5", "6"]], ["a", "col_1", "a_1", "col_3"], 2),
        ([["only"]], None, 0),
        ([["", " "], ["h", None], ["1", "2"]], ["h", "col_1"], 1),
    ],
)
def test_promotion(spark, body, columns, n):
    got = grid.promote(as_grid(spark, body)).collect()
    assert [(r.columns, r.n_rows) for r in got] == ([(columns, n)] if columns else [])


PLAN = tp.TablePlan.parse(
    '```json\n{"header_rows": [0, 1], "data_starts_at": 2, "id_columns": [{"col": 0, "name": "pair"}], "drop_rows": [3],'
    ' "melt": {"category_column": "role", "groups": [{"value_column": "dna", "sources": {"Mother": 1, "Infant": 2}}, {"value_column": "age", "sources": {"Infant": 3}}]}}\n```'
)


def test_melt_is_category_major_and_pads(spark):
    g = as_grid(spark, [["", "DNA", "", "Age"], ["pair", "Mother", "Infant", "Infant"], ["1", "5", "", ""], ["note"], ["2", "", "7"], ["3"]])
    got = [tuple(r) for r in tp.execute(g, PLAN).orderBy("row_idx", "cat_idx").select("pair", "role", "dna", "age").collect()]
    assert got == [("1", "Mother", "5", ""), ("2", "Infant", "7", "")]
    keep = tp.TablePlan(PLAN.header_rows, 2, PLAN.id_columns, tp.Melt("role", PLAN.melt.groups, False), (3,))
    assert tp.execute(g, keep).count() == 6


@pytest.mark.parametrize("change", [{"header_rows": (9,)}, {"data_starts_at": 6}, {"data_starts_at": -1}, {"id_columns": ((9, "x"),)}, {"drop_columns": (7,)}])
def test_plans_that_do_not_fit(spark, change):
    import dataclasses

    with pytest.raises(tp.PlanError):
        tp.check(dataclasses.replace(PLAN, **change), 6, 4)
    with pytest.raises(tp.PlanError):
        tp.TablePlan.parse("no plan")


def test_merged_headers_and_dropped_fields():
    assert tp.merged_header([["A", "", "B"], ["x", "y", "B"]]) == ["A | x", "A | y", "B"]
    plan = tp.TablePlan((0,), 1, ((0, "Run"),))
    kept = tp.with_dropped_fields(plan, ["Run", "instrument_model", "zzz"], ["ncbi_accession", "sequencing_platform"])
    assert kept.id_columns == ((0, "Run"), (1, "instrument_model"))
    assert tp.with_dropped_fields(PLAN, ["Run", "instrument_model"], ["sequencing_platform"]) is PLAN


TOY = schema.Schema.of([{"name": "sample_id", "description": ""}, {"name": "sex", "description": "", "type": "enum", "allowed_values": ["male", "female"]}, {"name": "body_site", "description": ""}])


def test_engine_anchors_on_the_most_relevant_table(spark):
    dump = [["sample_id", "sex"], *[[f"d{i}", "weird"] for i in range(25)]]
    study = [["Sample", "gender", "body_site"], *[[f"s{i}", ["male", "female"][i % 2], "gut"] for i in range(5)]]
    extra = [["sample_id", "note"], *[[f"s{i}", f"n{i}"] for i in range(5)]]
    g = as_grid(spark, dump, "dump").unionByName(as_grid(spark, study, "study")).unionByName(as_grid(spark, extra, "extra"))
    out = Engine(spark).samples(g, TOY)
    assert out.rows.count() == 5 and {"sample_id", "sex", "body_site", "note"} <= set(out.rows.columns)
    assert out.log.anchor == "study" and [j["right"] for j in out.log.joined] == ["extra"] and out.log.skipped[0]["right"] == "dump"


def test_engine_falls_back(spark):
    own = as_grid(spark, [["x", "y"], ["1", "2"]], "own")
    manifest = as_grid(spark, [["run_accession", "sample_id", "body_site"], *[[f"r{i}", f"s{i}", "gut"] for i in range(5)]], "manifest")
    out = Engine(spark).samples_or_manifest(own, manifest, TOY)
    assert out.rows.count() == 5 and any("manifest" in w for w in out.warnings)
    bad = Engine(spark, planner=lambda n, h, f: tp.TablePlan((0,), 99, ())).samples(manifest, TOY)
    assert bad.rows.count() == 5 and any("first row" in w for w in bad.warnings)


ANSWER = """{"granularity": "sample_level", "subgroups": ["women"], "fields": {
 "sex": {"value": "mixed", "by_subgroup": {"women": "female"}, "extraction_type": "inferred", "confidence": "low", "evidence_quote": "q", "section": "s"},
 "ages": {"value": ["1", "2"], "extraction_type": "derived", "confidence": "high", "evidence_quote": "", "section": ""}},
 "samples": [{"sample_id": "a", "group": "Woman"}, {"sample_id": "b", "age": 7, "group": "women"}]}"""


def test_stored_answers_become_records(spark):
    raw = spark.createDataFrame([("p", 0, f"Here:\n```json\n{ANSWER}\n```"), ("q", 0, "sorry"), ("r", 0, ANSWER.replace('"low"', '"odd"'))], "paper_id string, batch_idx int, raw string")
    errors = {r.paper_id: r.error for r in results.parsed(raw).collect()}
    assert errors["p"] is None and errors["q"] and errors["r"]
    samples, fields = Engine(spark).records(raw)
    got = {r.row_idx: {k: v.toPython() for k, v in r["values"].items()} for r in samples.collect()}
    assert got[0]["ages"] == "1; 2" and got[1]["age"] == 7
    assert got[1]["sex"] == "female" and got[1]["age_min"] == "7" and got[0]["sex"] == "mixed" and {r.field for r in fields.collect()} == {"sex", "ages"}
    assert results.snapshot(results.parsed(raw)).where("level = 'sample'").count() == 5
    ages = results.snapshot(results.parsed(raw)).where("study = 'p' AND field = 'ages'").collect()
    assert sorted(r.value for r in ages) == ["1", "2"]


def test_schemas():
    linkml = """
classes: {sample: {slots: [sex, age, tags, free], attributes: {own: {range: bool}}}}
slots: {sex: {range: SexEnum, required: true}, age: {range: integer, description: years, unit: a}, tags: {range: SexEnum, multivalued: true}, free: {range: DynEnum, description: .nan}}
enums: {SexEnum: {permissible_values: {male: {description: m, meaning: "X:1"}, other: }}, DynEnum: {reachable_from: {}}}
"""
    s = schema.parse(linkml, "x.yaml")
    assert [f.type for f in s.fields] == ["enum", "number", "list", "string", "boolean"] and s.fields[0].allowed_values == ("male", "other") and s.fields[0].required
    assert s.fields[0].value_descriptions == {"male": "m (X:1)"} and [f.description for f in s.fields] == ["sex", "years", "tags", "free", "own"] and s.fields[1].unit == "a"
    assert len(schema.Schema.of([{"name": f"f{i}"} for i in range(65)]).batches()) == 3
    assert schema.parse('[{"name": "a", "type": "number"}]', "x.unknown").names == ["a"]
    for bad in ('{"fields": []}', '{"x": 1}', '[{"name": "a", "type": "enum"}]', "{"):
        with pytest.raises(schema.SchemaError):
            schema.parse(bad, "x.json")


def test_retries_and_ladder():
    import urllib.error

    tries = []

    def opener(request, timeout):
        tries.append(1)
        if len(tries) < 3:
            raise urllib.error.HTTPError("u", 429, "slow", {}, None)
        return io.BytesIO(b"ok")

    assert web.http_get("http://x", opener=opener, sleep=lambda s: None) == b"ok" and len(tries) == 3
    good = "<article><body>" + "Introduction Methods Results Discussion Conclusion Background " * 60 + "</body></article>"
    pages = {"elink": b"<r><LinkSet><LinkSetDb><LinkName>pubmed_pmc</LinkName><Link><Id>77</Id></Link></LinkSetDb></LinkSet></r>", "db=pmc": b"<article><body>stub</body></article>",
             "db=pubmed": b"<r><ArticleTitle>T</ArticleTitle><AbstractText Label='AIM'>why</AbstractText><ArticleId IdType='doi'>10.1/x</ArticleId></r>", "PMC77/fullTextXML": good.encode()}

    def get(url):
        return next(v for k, v in pages.items() if k in url)

    paper = web.fetch("pmid", "5", get)
    assert paper.source == "europepmc_fulltext" and paper.has_body and paper.pmcid == "77"
    with pytest.raises(web.FetchError):
        web.fetch("pmcid", "1", lambda u: (_ for _ in ()).throw(OSError()))


def test_archive_and_store():
    tsv = b"run_accession\tlibrary_source\nR1\tx\nR2\n"
    assert web.run_manifest("P", lambda u: tsv if "tax_id" not in u else b"error") == [["run_accession", "library_source"], ["R1", "x"], ["R2", ""]]
    assert web.projects_of("R1", lambda u: b"study_accession\nP1\tz\nP1\nP2\n") == ["P1", "P2"]
    listing = b"<Prefix>PMC5.2/</Prefix><Prefix>PMC5.10/</Prefix><Prefix>PMC55.11/</Prefix>"
    assert web.latest_version(listing, "5") == "PMC5.10/"
    assert web.listed_tables(b"<Key>a/x.csv</Key><Key>b/X.CSV</Key><Key>a/y.pdf</Key>") == ["a/x.csv"]
    blob = io.BytesIO()
    with zipfile.ZipFile(blob, "w") as z:
        z.writestr("d/x.csv", "archive")
        z.writestr("z.tsv", "zip")

    def get(url):
        if "delimiter" in url:
            return listing
        if "supplementaryFiles" in url:
            return blob.getvalue()
        if url.endswith("x.csv"):
            return b"store"
        raise OSError(url)

    found, failed = web.supplements("PMC5", get, [("x.csv", ""), ("gone.csv", "")])
    assert found == [("x.csv", "store", b"store"), ("z.tsv", "archive", b"zip")] and failed == [("gone.csv", "not in the object store")]


def test_sinks(spark, tmp_path):
    f = spark.createDataFrame([("p", "a", "1", "e", "s", "low"), ("p", "b", None, "", "", "high")], "paper_id string, field string, value string, evidence_quote string, section string, confidence string")
    assert sinks.study_rows(f, ["a", "b"], provenance=True).first().asDict() == {"paper_id": "p", "a": "1", "a__evidence": "e", "a__section": "s", "a__confidence": "low", "b": "", "b__evidence": "", "b__section": "", "b__confidence": "high"}
    s = spark.createDataFrame([("p", {"z": "1"}), ("p", {"a": None})], "paper_id string, values map<string,string>")
    assert sinks.sample_rows(s).columns == ["paper_id", "a", "z"]
    sinks.write_csv(s.select("paper_id").where("false"), str(tmp_path / "none"))
    assert sinks.sample_rows(s.where("false"), columns=["q"]).columns == ["paper_id", "q"]
    assert spark.sql("""SELECT parse_json('["a", null, ["b", 1]]') AS x""").select(sinks.cell_text(F.col("x"), True)).first()[0] == "a; ; b; 1"
