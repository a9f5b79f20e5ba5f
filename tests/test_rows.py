"""Headers, accessions and log lines as rows, against plain versions."""

import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gristmill.operators import accessions, mapping, runs

LETTERS = st.text(alphabet="abcd_é ", max_size=12)


def plain_ratio(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        corner = 0
        for j, y in enumerate(b):
            corner, row[j + 1] = row[j + 1], corner + 1 if x == y else max(row[j + 1], row[j])
    return 200.0 * row[-1] / (len(a) + len(b)) if a or b else 100.0


@settings(max_examples=300, deadline=None)
@given(LETTERS, LETTERS)
def test_ratio_counts_insertions_and_deletions(a, b):
    assert mapping.ratio(a, b) == plain_ratio(a, b)


@settings(max_examples=200, deadline=None)
@given(st.lists(LETTERS.filter(bool), min_size=1, max_size=6, unique_by=str.lower), LETTERS, st.sampled_from([50.0, 80.0, 90.0]))
def test_the_first_of_the_likest_fields_is_taken(fields, header, least):
    found = mapping.Headers(fields, {}, True, least).target(header)
    if found is None or found[1] == "fuzzy":
        scores = [plain_ratio(header.lower(), f.lower()) for f in fields]
        want = (fields[scores.index(max(scores))], "fuzzy", max(scores)) if max(scores) >= least else None
        assert found == want


def test_header_rows_are_mapped_as_lists_are(spark):
    fields = ["sample_id", "body_site", "disease", "sex", "country"]
    lists = {0: ["Sample_ID", "sampleid", "diseases", "Gender", "sex", "x"], 1: ["disaese", "bodysite", "Body Site"], 2: []}
    rows = [(t, i, h) for t, hs in lists.items() for i, h in enumerate(hs)] + [(3, 0, None)]
    got = mapping.map_header_rows(spark.createDataFrame(rows, "table_id int, col_idx int, header string").repartition(3), fields).collect()
    assert len(got) == len(rows)
    for t, hs in lists.items():
        m = mapping.map_headers(hs, fields)
        assert {r.header: r.field for r in got if r.table_id == t and r.field and not r.collided} == m.mapped
        assert {(r.header, r.field) for r in got if r.table_id == t and r.collided} == set(m.collisions)
        assert {r.header: r.tier for r in got if r.table_id == t and r.field and not r.collided} == m.tier


def plain_mine(text):
    out = {}
    for kind, pattern in accessions.PATTERNS.items():
        for m in re.finditer(pattern, text):
            window = text[max(0, m.start() - 250) : m.end() + 250].lower()
            old = out.get(m.group(), (kind, 0, 0))
            out[m.group()] = (kind, max(old[1], sum(t in window for t in accessions.CONTEXT_TERMS)), old[2] + 1)
    return out


def test_accessions_equal_a_plain_search(spark):
    rng = random.Random(6)
    words = ["PRJNA1", "PRJEB22", "SRR123456", "ERP00001", "SAMEA77", "xPRJNA1", "éPRJDB4", "deposited", "İ available at", "the", "SRA", " sra ", "x" * 120, "\n"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 60))) for _ in range(40)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(100, None), (101, "")]
    got = {}
    for r in accessions.mine(spark.createDataFrame(rows, "id int, t string").repartition(3), "id", "t").collect():
        got.setdefault(r.id, {})[r.value] = (r.kind, r.context_score, r.n)
    assert got == {i: plain_mine(t) for i, t in enumerate(texts) if plain_mine(t)}


LOG = ["started", "cmd: a", "[fetched pmc for x]", "status: FAIL rc=1", "elapsed_s: 3.5", "cmd: a again", "[fetched abstract for x]", "[fetched pmc for x]", "status: ok", "status: late", "elapsed_s: 2"]


@pytest.mark.parametrize("span", [2, 1 << 16])
def test_attempts_and_ledger(spark, monkeypatch, span):
    monkeypatch.setattr(runs, "SPAN_LINES", span)
    lines = [("s", 1, i, x) for i, x in enumerate(LOG)] + [("s", 2, 0, "cmd: b"), ("t", 1, 5, None)]
    tried = runs.attempts(spark.createDataFrame(lines, "study string, run int, at long, line string").repartition(3))
    got = {(r.study, r.run, r.attempt): (r.started, r.status, r.elapsed_s, r.source) for r in tried.collect()}
    assert got == {
        ("s", 1, 0): (0, None, None, "?"), ("s", 1, 1): (1, "FAIL rc=1", 3.5, "pmc"), ("s", 1, 2): (5, "ok", 2.0, "abstract"), ("s", 2, 1): (0, None, None, "?"), ("t", 1, 0): (5, None, None, "?"),
    }
    assert {(r.study, r.run): (r.status, r.n_attempts) for r in runs.last_attempts(tried).collect()} == {("s", 1): ("ok", 2), ("s", 2): (None, 1), ("t", 1): (None, 0)}
    found = spark.createDataFrame([("s", 1, 7), ("u", 2, 3)], "study string, run int, n_samples long")
    golds = spark.createDataFrame([("s", 1, 9), ("s", 2, 8)], "study string, run int, n_gold long")
    by = {r.study: r.asDict() for r in runs.ledger(found, tried, golds, [1, 2]).collect()}
    assert by["s"] == {"study": "s", "run1": 7, "status1": "ok", "source1": "abstract", "run2": None, "status2": "fail", "source2": "?", "gold": 8}
    assert by["u"] == {"study": "u", "run1": None, "status1": "fail", "source1": "?", "run2": 3, "status2": "ok", "source2": "?", "gold": None}
