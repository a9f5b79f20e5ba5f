"""The pipeline, toxicity and language as registered, against plain versions."""

import math
import os
import zlib
from collections import defaultdict

import pytest

import corpus_pipeline
from gristmill.llm import packing
from gristmill.llm.queries import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}


def sql(text, path):
    import duckdb

    c = duckdb.connect()
    c.execute(f"create view documents as select * from read_parquet('{path}')")
    found = c.sql(text)
    return [dict(zip(found.columns, row)) for row in found.fetchall()]


def test_pipeline_keeps_packs_and_drops_what_it_should(spark, docs, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq
    from tokenizers import Tokenizer

    rows = corpus_pipeline.run(spark, SMALL).collect()
    kept = {r["doc_id"] for r in sql(ORACLES["op5_quality"], f"{SMALL}/documents.parquet") if r["kept"]}
    pq.write_table(pa.table({"doc_id": sorted(kept), "text": [docs[d].text for d in sorted(kept)]}), tmp_path / "kept.parquet")
    groups = defaultdict(list)
    for r in sql(ORACLES["op9_jaccard"], f"{tmp_path}/kept.parquet"):
        groups[r["component_id"]].append(r["doc_id"])
    seen = {r.doc_id for r in rows}
    assert seen <= kept and all(len(seen & set(g)) <= 1 for g in groups.values())
    # the mix takes more words than there are, so nearly every group is in it
    assert len(seen) > 0.6 * len(groups)

    tool = Tokenizer.from_file(packing.tokenizer_path())
    pieces, ends = defaultdict(list), defaultdict(int)
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends[r.sequence_id] and r.ids_crc32 == zlib.crc32(b"".join(int(i).to_bytes(4, "little") for i in r.ids))
        ends[r.sequence_id] += r.length
        pieces[r.doc_id].append(r)
    assert max(ends.values()) <= 2048 and sorted(ends) == list(range(len(ends)))
    for d, parts in pieces.items():
        tokens = parts[0].doc_tokens
        copies = sum(p.length for p in parts) / tokens
        assert copies in (1, 2) and {p.doc_tokens for p in parts} == {tokens}
        by_start = defaultdict(list)
        for p in parts:
            by_start[p.start].append(list(p.ids))
        whole, at = [], 0
        while at < tokens:  # copies may be cut in different places
            ids = by_start[at][0] if by_start[at] else next(x[at - s :] for s in sorted(by_start) for x in by_start[s] if s < at < s + len(x))
            whole += ids
            at += len(ids)
        assert whole[-1] == 1 and len(whole) == tokens
        text = tool.decode(whole[:-1], skip_special_tokens=False)
        mine = tool.encode(docs[d].text, add_special_tokens=False).ids
        left = iter(mine)
        assert all(x in left for x in whole[:-1]), (d, text[:80])  # what stays is the document's, in order


def rates(rows, truth, of):
    hit = [of(r) == truth[r.doc_id] for r in rows if r.held_out and r.doc_id in truth]
    return sum(hit), len(hit)


def test_toxicity_as_registered(spark, docs):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect() if r.toxic is not None}
    rows = QUERIES["op6_toxicity"](spark, SMALL).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) and not math.isnan(r.score)
    by_text = defaultdict(set)
    for r in rows:
        by_text[docs[r.doc_id].text].add(round(r.score, 12))
    assert all(len(s) == 1 for s in by_text.values())  # nothing but the text counts
    learned = [r for r in rows if not r.held_out and r.doc_id in labels]
    assert sum(r.predicted == labels[r.doc_id] for r in learned) >= 0.95 * len(learned)
    hits, n = rates(rows, labels, lambda r: r.predicted)
    assert hits >= 0.85 * n


def test_language_as_registered(spark, docs):
    rows = QUERIES["op10_language"](spark, SMALL).collect()
    langs = {r.lang for r in docs.values() if r.lang is not None}
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    for r in rows:
        text = docs[r.doc_id].text
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (text is None or not any(c.isalpha() for c in text)) and r.lang_pred in langs | {"und"}
    truth = {d: r.lang for d, r in docs.items() if r.lang is not None and r.text and any(c.isalpha() for c in r.text)}
    hits, n = rates(rows, truth, lambda r: r.lang_pred)
    assert hits >= 0.95 * n
