import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gristmill.functions import ages, jsontext, markup, missing, narrative, strings, values


def one(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


@pytest.mark.parametrize(
    "text, number",
    [("1", 1.0), (" 2.5 ", 2.5), ("1e3", 1000.0), (".5", 0.5), ("5.", 5.0), ("1_000", 1000.0), ("1d", None), ("0x1p3", None), ("", None), ("1__0", None), (None, None), ("-inf", -math.inf)],
)
def test_numbers_as_text(spark, text, number):
    assert one(spark, [(text,)], "x string", values.to_number(F.col("x"))) == [(number,)]


DECISIONS = [
    (None, None, "TN"), ("NA", "n/a", "TN"), (None, "x", "FN"), ("x", "", "FP"), ("X ", "x", "TP_correct"), ("x", "y", "TP_wrong"),
    ("100", "104", "TP_correct"), ("100", "106", "TP_wrong"), ("0", "0.0", "TP_correct"), ("0.1", "0", "TP_wrong"), ("nan", "nan", "TP_wrong"), ("nan", None, "FP"),
]


def test_cell_decisions(spark):
    got = one(spark, [(i, e, g) for i, (e, g, _) in enumerate(DECISIONS)], "i int, e string, g string", "i", values.decision(F.col("e"), F.col("g")))
    assert [d for _, d in sorted(got)] == [d for *_, d in DECISIONS]


def test_units_become_years(spark):
    rows = [("24", "2", "months", None), ("24", "2", "Weeks", None), ("24", "24", "parsecs", None)]
    got = one(spark, rows, "e string, g string, u string, v string", values.decision(F.col("e"), F.col("g"), extracted_unit=F.col("u"), gold_unit=F.col("v")))
    assert [x for x, in got] == ["TP_correct", "TP_wrong", "TP_correct"]


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.one_of(st.none(), st.text("aN/ ", max_size=4), st.floats(-9, 9).map(lambda x: f"{x:.2f}")), st.one_of(st.none(), st.text("aN/ ", max_size=4), st.floats(-9, 9).map(lambda x: f"{x:.2f}"))), min_size=1, max_size=20))
def test_decisions_follow_a_small_model(spark, pairs):
    def number(x):
        try:
            return float(x)
        except (TypeError, ValueError):
            return None

    def gone(x):
        return x is None or x.strip().lower() in ("not_reported", "na", "n/a", "", "none", "null")

    def model(e, g):
        if gone(e) or gone(g):
            return "TN" if gone(e) and gone(g) else "FN" if gone(e) else "FP"
        a, b = number(e), number(g)
        if a is None or b is None:
            good = e.strip().lower() == g.strip().lower()
        else:
            good = abs(a) < 1e-9 if b == 0 else abs(a - b) / max(abs(b), 1e-9) <= 0.05
        return "TP_correct" if good else "TP_wrong"

    rows = [(i, e, g) for i, (e, g) in enumerate(pairs)]
    got = one(spark, rows, "i int, e string, g string", "i", values.decision(F.col("e"), F.col("g")))
    assert [d for _, d in sorted(got)] == [model(e, g) for _, e, g in rows]


def test_missing_predicates_differ(spark):
    rows = [(x,) for x in (None, "", "NA", "nan", "Not Reported", "12", " na ")]
    checks = [missing.not_scored, missing.not_fanned, missing.no_age, missing.no_cell, missing.no_sample, missing.no_accession, missing.no_publication, missing.no_unit, missing.no_term]
    got = one(spark, rows, "x string", *[c(F.col("x")) for c in checks])
    assert [list(map(int, r)) for r in got] == [
        [1, 1, 1, 1, 1, 1, 1, 1, 1], [1, 1, 1, 1, 1, 1, 1, 1, 1], [1, 0, 1, 0, 0, 1, 1, 1, 1], [0, 0, 1, 0, 0, 1, 1, 0, 1],
        [0, 1, 1, 0, 0, 0, 0, 0, 0], [0, 0, 0, 0, 0, 0, 0, 0, 0], [1, 0, 1, 0, 0, 1, 1, 0, 1],
    ]


def test_strings(spark):
    got = one(
        spark, [("Sample-ID (x)", "SRR1; SRR2", "a/b ;NA, c")], "h string, a string, t string",
        strings.squeezed(F.col("h")), strings.tokens(F.col("h")), strings.accession_key(F.col("a")), strings.terms(F.col("t")), strings.codes(F.col("t")),
    )
    assert got == [("sampleidx", ["sample", "id", "x"], "SRR1", ["a", "b", "c"], ["a/b", "c"])]


def test_identifiers(spark):
    got = one(spark, [("PMID: 12",), ("pmcid:PMC7",), ("PMC9",), (" 5 ",), ("doi",)], "x string", strings.identifier(F.col("x")))
    assert [r and tuple(r) for r, in got] == [("pmid", "12"), ("pmcid", "7"), ("pmcid", "9"), ("pmid", "5"), None]


AGES = [
    (("34", None, "Adult", None, None), ("34", "34", 2)),
    (("34", None, None, "30", None), ("30", "34", 1)),
    ((None, "2.5", None, None, None), ("2.5", "2.5", 2)),
    (("NA", None, "Adult", None, None), ("18", "65", 2)),
    (("NA", None, "Adult", "23", None), ("23", None, 0)),
    ((None, None, "Newborn", None, None), (None, None, 0)),
    ((None, None, " Elderly ", "not reported", None), ("65", "130", 2)),
    (("x", None, None, None, None), (None, None, 0)),
]


def test_age_bounds(spark):
    rows = [(i, *r) for i, (r, _) in enumerate(AGES)]
    got = one(spark, rows, "i int, a string, y string, g string, l string, h string", "i", ages.age_bounds(*[F.col(c) for c in "ayglh"]))
    assert [tuple(x) for _, x in sorted(got, key=lambda r: r[0])] == [w for _, w in AGES]


def test_narrative_prefers_articles_to_dumps(spark):
    article = "Introduction\nwords " * 40 + "\nMethods\nResults\nDiscussion\nConclusion\nData availability\n" + "prose " * 2000
    dump = "k__Bacteria|p__Firmicutes 0.1\n" * 1200
    listed = article + "\nReferences\n" + "Someone et al.\n" * 400
    got = dict(one(spark, [("article", article), ("dump", dump), ("blank", " "), ("listed", listed)], "k string, t string", "k", narrative.narrative_score(F.col("t"), F.lit("x"))))
    assert got["article"] > 1.5 > got["dump"] and got["blank"] == 0 and abs(got["listed"] - got["article"]) < 0.4


def test_tail_is_cut_only_where_it_is_one(spark):
    rows = [("a" * 50 + "\nReferences\nx",), ("a\nReferences\n" + "b" * 50,), ("see references here",), ("a" * 30 + "\nReferences\n" + "b" * 30 + "\nBibliography\nz",)]
    got = [t for t, in one(spark, rows, "t string", narrative.strip_tail(F.col("t")))]
    assert got == ["a" * 50, rows[1][0], rows[2][0], rows[3][0][: rows[3][0].index("\nBibl")]]


def test_json_is_found_in_prose():
    assert jsontext.json_object('so:\n```json\n{"a": 1}\n```\nend') == '{"a": 1}'
    assert jsontext.json_object('x {"a": "}\\"", "b": {}} y') == '{"a": "}\\"", "b": {}}'
    assert jsontext.json_object('x {"a": 1 ') == '{"a": 1'
    assert jsontext.json_object(" none ") == "none" and jsontext.json_object(None) is None


def test_markup():
    from xml.etree import ElementTree

    xml = "<body>A<p>one <i>two</i> three</p><fig>out<p>in</p>tail</fig></body>"
    assert markup.flatten_xml(ElementTree.fromstring(xml)) == "A one two three in tail"
    assert markup.flatten_xml(ElementTree.fromstring("<p>one<b>x<i>y</i></b>tail</p>")) == "one x tail y"
    assert markup.flatten("<p>a<br>b &amp; c<script>x()</script>") == "a b & c"
    data = '<article xmlns:xlink="http://www.w3.org/1999/xlink"><article-title>T</article-title><body/><supplementary-material xlink:href="a.csv"/><supplementary-material><media xlink:href="A.CSV"/></supplementary-material><supplementary-material xlink:href="none"/></article>'
    found = markup.article(data)
    assert found["text"] == "TITLE: T" and not found["has_body"]
    assert markup.supplement_links(found["element"], "http://x/bin") == [("a.csv", "http://x/bin/a.csv")]
    assert markup.article("<broken") is None


def test_narrative_score_is_one_rule_in_both_places(spark):
    import random

    from gristmill.sources import web

    rng = random.Random(12)
    bits = ["Introduction", "results ", "Methods\n", "k__Bacteria\n", "GCF_12\n", "plain words here\n", "\nReferences\n", "\n  bibliography \n", "\n\n", "x" * 900 + "\n", "\r\n", "Discussion of it. "]
    texts = ["", " \n"] + ["".join(rng.choice(bits) for _ in range(rng.randint(1, 40))) for _ in range(120)]
    rows = [(t, rng.choice(["pmc_fulltext", "other"])) for t in texts]
    got = one(spark, rows, "t string, s string", "t", "s", narrative.narrative_score(F.col("t"), F.col("s")).alias("score"))
    assert len(got) == len(rows)
    for text, source, score in got:
        assert score == pytest.approx(web.narrative_value(text, source)), text


def test_a_manifest_at_its_limit_is_warned_of(monkeypatch):
    from gristmill.sources import web

    monkeypatch.setattr(web, "MOST_RUNS", 3)
    page = "run_accession\tx\n" + "".join(f"R{i}\t{i}\n" for i in range(3))
    rows, warnings = web.manifest_for(["P"], lambda url: page.encode())
    assert len(rows) == 4 and len(warnings) == 1 and "3 runs" in warnings[0]
