"""Edge cases of every operator: nulls, empty and long texts, ties, repeated rows, empty tables, extra columns."""

import pytest
from pyspark.sql import functions as F

from gristmill.llm import fingerprint, jaccard, language, license_scan, mixing, ngram_model, packing, quality, substring, toxicity

LONG = "word salad with some more words. " * 6000
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, score string, label string, row string, cls string"
ROWS = [
    (1, None, "en", None, None), (2, "", "en", "a", 0), (3, " \t\n", None, "a", 3), (4, "One two three.", "en", "b", 14), (4, "One two three.", "en", "b", 14),
    (5, "Another text, longer than the first one.", None, None, 40), (None, "No id at all here.", "de", "b", 18), (None, None, None, None, None), (6, LONG, "fr", "a", len(LONG)),
    (7, "naïve café — 東京 𝒳 words", "fr", "b", 20), (8, " odd space", "en", "b", 9),
]


@pytest.fixture(scope="module")
def docs(spark):
    extra = ("x",) * 5
    return spark.createDataFrame([(*r, *extra) for r in ROWS], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("doc_id = -1")


def test_quality(docs, none):
    got = quality.quality_cascade(docs, report=("n_words", "n_dup_lines"))
    assert got.count() == len(ROWS) and not got.where("doc_id <= 2").where("kept").count()
    assert {r.n_words for r in got.where("doc_id = 4").collect()} == {3}
    assert quality.keep_good(docs).columns == docs.columns
    assert quality.quality_cascade(none).count() == 0 and quality.keep_good(none).count() == 0


def test_language(docs, none):
    model = language.train(docs, "text", "lang")
    got = {r.doc_id: r for r in language.identify(docs, model).collect()}
    assert len(language.identify(docs, model).collect()) == len(ROWS)
    assert got[1].lang_pred == got[2].lang_pred == got[3].lang_pred == "und" and got[1].spans == [] and 0 <= got[4].score <= 1
    empty = language.train(none, "text", "lang")
    assert empty.langs == [] and {r.lang_pred for r in language.identify(docs, empty).collect()} == {"und"}
    assert language.identify(none, model).count() == 0


def test_toxicity(spark, docs, none):
    labels = spark.createDataFrame([(4, 1), (4, 0), (5, 0), (6, 0), (None, 1), (7, None), (99, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    got = toxicity.score(docs, model).collect()
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert toxicity.score(none, toxicity.train(none, labels.where("false"))).count() == 0
    assert {r.predicted for r in toxicity.score(docs, toxicity.train(docs, labels.where("false"))).collect()} == {0}


def test_ngram_model(docs, none):
    model, rare = ngram_model.train(docs)
    got = ngram_model.score(docs, model, rare).collect()
    assert len(got) == len(ROWS) and {r.n_tokens for r in got if r.doc_id in (1, 2, 3)} == {1}
    assert all(r.n_known == r.n_tokens and r.score < 0 for r in got)
    nothing, no_rare = ngram_model.train(none)
    assert {(r.n_known, r.base_score) for r in ngram_model.score(docs, nothing, no_rare).collect()} == {(0, 0.0)}
    assert ngram_model.score(none, model, rare).count() == 0


def test_packing(docs, none):
    got = packing.pack(docs, window=16)
    pieces = got.collect()
    assert sum(r.length for r in pieces) == sum({(r.doc_id, r.doc_tokens, i): r.doc_tokens for i, r in enumerate(pieces) if r.start == 0}.values())
    assert sorted(r.doc_tokens for r in pieces if r.start == 0)[:4] == [1, 1, 1, 1] and len([r for r in pieces if r.start == 0]) == len(ROWS)
    assert packing.pack(none).count() == 0


def test_mixing(docs, none):
    got = mixing.mix_counts(docs).collect()
    assert len(got) == len(ROWS) and all(0 <= r.taken <= 2 * r.size for r in got)
    assert {r.source_size for r in got if r.doc_id == 5} == {7} and {r.size for r in got if r.doc_id == 1} == {0}
    assert mixing.mix(docs).columns == docs.columns
    assert mixing.mix_counts(none).count() == 0 and mixing.mix(none).count() == 0


def test_fingerprint(docs, none):
    got = fingerprint.compare_neighbours(docs).collect()
    assert len(got) == len(ROWS) and {r.fingerprint for r in got if r.doc_id in (1, 2)} == {"0::"}
    assert len({r.fingerprint for r in got if r.doc_id == 4}) == 1 and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert fingerprint.fingerprint_documents(docs).count() == len(ROWS)
    assert fingerprint.compare_neighbours(none).count() == 0
    alone = fingerprint.compare_neighbours(docs.where("doc_id = 5")).collect()
    assert len(alone) == 1 and alone[0].near_next == 1.0


def test_substring(docs, none):
    got = substring.dedup_substrings(docs)
    assert got.columns == [*docs.columns, "n_sentences", "n_removed"] and got.count() == len(ROWS)
    kept = {r.doc_id: r.text for r in got.collect()}
    assert kept[1] is None and kept[2] == "" and kept[3] == " \t\n" and kept[7] == ROWS[9][1] and len(kept[6]) < len(LONG)
    assert substring.dedup_substrings(none).count() == 0


def test_jaccard(docs, none):
    got = jaccard.near_duplicates(docs).collect()
    assert len(got) == len(ROWS)
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got if r.doc_id in (1, 2, 3, 4)} == {(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4)}
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == len(ROWS) - 1
    assert jaccard.near_duplicates(none).count() == 0 and jaccard.keep_one(none).count() == 0


def test_license(docs, none):
    got = license_scan.scan_licenses(docs).collect()
    assert len(got) == len(ROWS) and all(r.n_found == 0 for r in got)
    assert license_scan.scan_licenses(none).count() == 0
    assert {r.n_found for r in license_scan.scan_licenses(docs, templates={}).collect()} == {0}


def test_pipeline_stages(spark, docs, none):
    import corpus_pipeline

    real = docs.select("doc_id", "text", "lang", "source", "n_chars")
    for rows in (real, real.where("doc_id = -1")):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, rows, "").columns == real.columns, name
        assert "sequence_id" in corpus_pipeline.STAGES[-1][1](spark, rows, "").columns
    assert corpus_pipeline.STAGES[2][1](spark, real, "").where(F.length("text") != F.col("n_chars")).count() == 0


def test_equal_rows_and_keys_of_any_type(spark):
    text = " ".join(f"Sentence number {i} has some words of its own here." for i in range(30))
    rows = [("b", text), ("a", text), (None, text), (None, text), ("a", text), ("c", None)]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    got = substring.dedup_substrings(docs)
    assert sorted(r.n_removed for r in got.collect()) == [0, 0, 30, 30, 30, 30] and {r.doc_id for r in got.where("n_removed = 0").collect()} == {"a", "c"}
    one_key = spark.createDataFrame([(1, text), (1, text), (1, text + " More.")], "doc_id long, text string")
    assert sorted(r.n_removed for r in substring.dedup_substrings(one_key).collect()) == [0, 30, 30]
    near = fingerprint.compare_neighbours(docs).collect()
    assert [r.doc_id for r in near if r.n_chars == 0] == ["c"] and len(near) == len(rows)


def test_columns_may_have_any_name(spark):
    names = ["doc_id", "text", "source", "row", "wordless", "order", "of", "no", "block", "shards", "shard", "copy", "id", "spans", "c0", "number"]
    rows = [(str(i), f"word{i} and some more words of text {i % 3}", "s", *[f"{n}{i}" for n in names[3:]]) for i in range(6)]
    docs = spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names))
    for run in (jaccard.keep_one, substring.dedup_substrings, mixing.mix, quality.keep_good):
        got = run(docs)
        assert got.columns[: len(names)] == names, run
        assert all(r[n] == f"{n}{r.doc_id}" for r in got.collect() for n in names[3:]), run
    packing.pack(docs).count()


def test_texts_longer_than_a_slab(spark):
    from gristmill.llm import _text

    words = [f"w{i % 977}x{i % 1013}" for i in range(300_000)]
    text = " ".join(words)
    assert len(text) > _text.SLAB_BYTES
    docs = spark.createDataFrame([(1, text), (2, "short one"), (3, text)], "doc_id long, text string")
    (n, *_), other = sorted((r.n_words for r in quality.quality_cascade(docs, report=("n_words",)).collect()), reverse=True), 2
    assert n == len(words)
    assert {r.component_id for r in jaccard.near_duplicates(docs).collect()} == {1, other}
    assert sum(r.size for r in mixing.mix_counts(docs.withColumn("source", F.lit("a"))).collect()) == 2 * len(words) + 2
    kept = {r.doc_id: r.text for r in substring.dedup_substrings(docs).collect()}
    assert kept[1] == text and len(kept[3]) < 100
