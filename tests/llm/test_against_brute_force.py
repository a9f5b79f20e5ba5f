"""Every operator against a plain version on small tables."""

import hashlib
import itertools
import math
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gristmill.llm import _text, fingerprint, jaccard, language, license_scan, mixing, ngram_model, packing, quality, substring, toxicity
from gristmill.llm.components import components
from gristmill.llm.queries import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"
here = pytest.mark.skipif(not os.path.isdir(SMALL), reason="the driver's tables are not here")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
VOCAB = [f"w{i}" for i in range(400)]


def lower(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s)


def sentences(rng, n, words=9):
    return " ".join(" ".join(rng.choice(VOCAB) for _ in range(rng.randint(4, words))).capitalize() + "." for _ in range(n))


@pytest.fixture(scope="module")
def small(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}


# ------------------------------------------------------------- text kernels


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB é東\n\t .", max_size=40)), min_size=1, max_size=6))
def test_words_are_those_of_the_pattern(texts):
    w = _text.Words(pa.array(texts, pa.string()))
    want = [[x for x in WORD.findall(t or "")] for t in texts]
    got = [[w.word_bytes(k).decode() for k in range(w.ptr[i], w.ptr[i + 1])] for i in range(w.n)]
    assert got == want
    by_key = {}
    for k in range(len(w.key)):
        by_key.setdefault(int(w.key[k]), set()).add(lower(w.word_bytes(k).decode()))
    assert all(len(v) == 1 for v in by_key.values()) and len(by_key) == len({lower(x) for ws in want for x in ws})


def test_words_of_many_chunks(monkeypatch):
    texts = ["alpha beta " * 50, "gamma", "alpha"]
    whole = _text.Words(pa.array(texts)).key
    monkeypatch.setattr(_text, "_CHUNK", 16)
    assert (_text.Words(pa.array(texts)).key == whole).all()


# ------------------------------------------------------------- 1 substring


def plain_dedup(docs):
    seen, out = set(), {}
    for doc, text in sorted(docs):
        s = substring.Sentences(pa.array([text]))
        words = [lower(w) for w in WORD.findall(text)]
        f, gone = s.first.tolist(), set()
        for k in range(len(f) - 1):
            e = next((e for e in range(k + 3, len(f)) if f[e] - f[k] >= 16), None)
            if e is None:
                continue
            run = tuple(words[f[k] : f[e]])
            if run in seen:
                gone |= set(range(k, e))
            seen.add(run)
        raw = text.encode()
        cuts = [*s.begin.tolist(), len(raw)]
        out[doc] = b"".join(raw[a:b] for i, (a, b) in enumerate(zip(cuts, cuts[1:])) if i not in gone).decode() if len(f) > 1 else text
    return out


def test_substring_equals_the_plain_version(spark):
    rng = random.Random(1)
    shared = [sentences(rng, 8) for _ in range(5)]
    docs = [(i, sentences(rng, rng.randint(1, 12)) + ("\n" + rng.choice(shared) + " " if i % 3 else " ") + sentences(rng, 3)) for i in range(60)]
    docs.append((60, docs[5][1]))
    docs.append((61, " ".join([sentences(rng, 4)] * 3)))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    assert {r.doc_id: r.text for r in substring.dedup_substrings(df).collect()} == plain_dedup(docs)


def test_a_passage_without_stops_is_caught(spark):
    rng = random.Random(2)
    passage = " ".join(rng.choice(VOCAB) for _ in range(60))
    docs = [(i, " ".join(rng.choice(VOCAB) for _ in range(50)) + " " + passage + " " + " ".join(rng.choice(VOCAB) for _ in range(50))) for i in range(4)]
    got = {r.doc_id: r.text for r in substring.dedup_substrings(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got[0] == docs[0][1] and all(len(got[i].split()) < 135 and docs[i][1].split()[:20] == got[i].split()[:20] for i in (1, 2, 3))


# ------------------------------------------------------------- 2 fingerprints


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=30), st.lists(st.sampled_from("abcd"), max_size=30))
def test_edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    assert fingerprint.edit_distance(a, b) == row[-1]


@here
def test_fingerprints_of_neighbours(spark, small):
    got = {r.doc_id: r for r in QUERIES["op2_fingerprint"](spark, SMALL).collect()}
    ids = sorted(small, reverse=True)
    assert set(got) == set(small)
    for doc, after in zip(ids, [*ids[1:], ids[0]]):
        a, b = small[doc].text, small[after].text
        third = len(a) // 3
        edited = a[: len(a) - third] + b[:third]
        r = got[doc]
        assert (r.n_chars, r.edited_sha256) == (len(a), hashlib.sha256(edited.encode()).hexdigest())
        assert r.fingerprint == fingerprint.fingerprint(a.encode()) and r.near_next == fingerprint.likeness(r.fingerprint, fingerprint.fingerprint(b.encode()))
    near = [r.near_edited for r in got.values() if r.n_chars > 200]
    assert sum(x > 0.3 for x in near) >= 0.98 * len(near) and np.median([r.near_next for r in got.values()]) < 0.05


@pytest.mark.parametrize("n", [0, 1, 2, 7, 10, 50])
def test_bounds_are_counted_in_two_steps(spark, n):
    from pyspark.sql import functions as F

    bounds = [float(3 * k) for k in range(n, 0, -1)]
    xs = [float(v) for v in range(-1, 3 * n + 4)]
    got = spark.createDataFrame([(v,) for v in xs], "x double").select("x", fingerprint._bounds_above(F.col("x"), bounds).alias("k")).collect()
    assert {r.x: r.k for r in got} == {v: sum(b > v for b in bounds) for v in xs}


def test_likeness_follows_the_edit():
    rng = random.Random(3)
    text = sentences(rng, 80).encode()
    marks = [fingerprint.likeness(fingerprint.fingerprint(text), fingerprint.fingerprint(text[: int(len(text) * s)] + sentences(rng, 80).encode()[: int(len(text) * (1 - s))])) for s in (0.9, 0.6, 0.3)]
    assert marks == sorted(marks, reverse=True) and marks[0] > 0.75 and marks[2] < 0.5


# ------------------------------------------------------------- 3 language model


@here
def test_base_scores(spark, small):
    tokens = {d: [lower(w) for w in WORD.findall(r.text)] + [None] for d, r in small.items()}
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in small}
    counts = Counter(t for d, ts in tokens.items() if not held[d] for t in ts)
    n, v = sum(counts.values()), len(counts)
    rows = QUERIES["op3_ngram_score"](spark, SMALL).collect()
    assert len(rows) == len(small)
    for r in rows:
        base = sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in tokens[r.doc_id])
        assert r.base_score == pytest.approx(base) and r.n_known == sum(counts[t] > 0 for t in tokens[r.doc_id])
        assert (r.held_out, r.n_tokens, r.train_tokens) == (held[r.doc_id], len(tokens[r.doc_id]), n)
    assert sum(r.score - r.base_score for r in rows if r.held_out) > 0


def test_rare_words_are_joined_exactly(spark, monkeypatch):
    monkeypatch.setattr(ngram_model, "HEAD_WORDS", 2)
    docs = spark.createDataFrame([(1, "a a a b b c"), (2, "a b c d zz")], "doc_id long, text string")
    model, rare = ngram_model.train(docs.where("doc_id = 1"))
    assert len(model.head_keys) <= 2
    got = {r.doc_id: r for r in ngram_model.score(docs, model, rare).collect()}
    counts, n, v = {"a": 3, "b": 2, "c": 1, None: 1}, 7, 4
    for doc, words in ((1, "a a a b b c"), (2, "a b c d zz")):
        ts = [*words.split(), None]
        assert got[doc].base_score == pytest.approx(sum(math.log10((counts.get(t, 0) + 1) / (n + v + 1)) for t in ts))
        assert got[doc].n_known == sum(t in counts for t in ts)


def test_the_filter_gives_back_levels(spark):
    rng = np.random.default_rng(0)
    words = [f"t{i}" for i in range(3000)]
    text = " ".join(w for i, w in enumerate(words) for _ in range(1 + i % 40))
    model, _ = ngram_model.train(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    keys = _text.Words(pa.array([" ".join(words)])).key
    got = ngram_model.count_at(model.filter.levels(ngram_model._word_entry(keys)))
    true = np.array([1 + i % 40 for i in range(3000)])
    assert (got >= true / 1.31).all() and np.mean(got <= true * 1.31) > 0.95
    unseen = model.filter.levels(rng.integers(0, 1 << 63, 20000).astype(np.uint64))
    assert (unseen > 0).mean() < 0.05


def test_a_filter_of_many_pages_drops_nothing(spark, monkeypatch):
    monkeypatch.setattr(ngram_model, "FILTER_BITS", ngram_model.SEGMENT_BITS)
    text = " ".join(f"t{i}" for i in range(30000))
    docs = spark.createDataFrame([(1, text), (2, text), (3, None), (4, text[: len(text) // 2])], "doc_id long, text string")
    model, rare = ngram_model.train(docs.where("doc_id <= 2"))
    assert model.segments is not None
    got = {r.doc_id: r.score for r in ngram_model.score(docs, model, rare).collect()}
    denominator, k = 60002 + 30001 + 1, model.prior  # every word and pair was seen twice
    plain = math.log10((2 + k * 3 / denominator) / (2 + k))
    for doc, n in ((1, 30001), (4, text[: len(text) // 2].count(" ") + 1)):
        assert got[doc] == pytest.approx(n * plain, abs=0.01 * n)
    assert got[3] == pytest.approx(math.log10(k * 3 / denominator / (2 + k)), rel=0.05)


@here
def test_a_shuffled_filter_scores_as_a_broadcast_one(spark, monkeypatch):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model, rare = ngram_model.train(docs)
    want = {r.doc_id: r for r in ngram_model.score(docs, model, rare).collect()}
    monkeypatch.setattr(ngram_model, "FILTER_BITS", ngram_model.SEGMENT_BITS)
    monkeypatch.setattr(ngram_model, "ASKED_BYTES", 1 << 18)
    shuffled, rare = ngram_model.train(docs)
    assert model.segments is None and shuffled.filter is None and shuffled.segments is not None
    got = ngram_model.score(docs, shuffled, rare).collect()
    assert len(got) == len(want)
    for r in got:
        assert r.score == pytest.approx(want[r.doc_id].score, rel=1e-12)  # the same levels
        assert (r.n_known, r.n_tokens) == (want[r.doc_id].n_known, want[r.doc_id].n_tokens)
        assert r.base_score == pytest.approx(want[r.doc_id].base_score)


def _quantised(count):
    """The middle of the whole numbers that share a count's level."""
    if not count:
        return 0.0
    level = math.floor(math.log(count) / math.log(ngram_model.SCALE) + 1e-9)
    same = [c for c in range(1, 2 * count + 2) if math.floor(math.log(c) / math.log(ngram_model.SCALE) + 1e-9) == level]
    return (min(same) + max(same)) / 2


@here
def test_scores_are_those_of_the_quantised_model(spark, small):
    tokens = {d: [lower(w) for w in WORD.findall(r.text or "")] + [None] for d, r in small.items()}
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in small}
    words = Counter(t for d, ts in tokens.items() if not held[d] for t in ts)
    pairs = Counter(p for d, ts in tokens.items() if not held[d] for p in zip([None, *ts], ts))
    n, v, once = sum(words.values()), len(words), sum(c == 1 for c in pairs.values())
    rows = QUERIES["op3_ngram_score"](spark, SMALL).collect()
    model, _ = ngram_model.train(spark.createDataFrame([(r.text,) for d, r in small.items() if not held[d]], "text string"))
    k = model.prior
    assert sum(c * k / (c + k) for c in words.values()) == pytest.approx(once, rel=0.1)  # means of levels stand for their words
    q = {c: _quantised(c) for c in {0, *words.values(), *pairs.values()}}
    near = []
    for r in rows:
        want = 0.0
        for h, t in zip([None, *tokens[r.doc_id]], tokens[r.doc_id]):
            together = min(q[pairs[h, t]], q[words[t]], q[words[h]])
            want += math.log10((together + k * (q[words[t]] + 1) / (n + v + 1)) / (q[words[h]] + k))
        near.append(abs(r.score - want) / abs(want))
    assert np.mean(near) < 0.02 and np.quantile(near, 0.95) < 0.05


def test_both_ways_read_the_same_levels(spark):
    rng = np.random.default_rng(4)
    text = " ".join(f"t{i}" for i in rng.zipf(1.3, 40000) % 9000)
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    broadcast, _ = ngram_model.train(docs)
    shuffled, _ = ngram_model.train(docs, filter_bits=1)
    keys = rng.integers(0, 1 << 64, 20000, dtype=np.uint64, endpoint=False)
    w = ngram_model.Probes.of(pa.array([text]))
    keys = np.concatenate([keys, w.entries])
    group = ngram_model.segment_of(keys, shuffled.n_groups)
    want = broadcast.filter.levels(keys)
    blobs = {r.bucket: np.frombuffer(r.bits, np.uint8) for r in shuffled.segments.collect()}
    got = np.zeros(len(keys), np.uint8)
    for g, bits in blobs.items():
        of = group == g
        got[of] = ngram_model.BloomCounts(bits, 1).levels_of(np.zeros(of.sum(), np.int64), ngram_model.rests(keys[of]))
    assert (got == want).all() and (want[20000:] > 0).all() and (want[:20000] > 0).mean() < 0.05


@settings(max_examples=50, deadline=None)
@given(st.integers(1, 10**9))
def test_levels_stay_near_counts(count):
    level = ngram_model.level_of(np.array([count]))
    assert abs(math.log(ngram_model.count_at(level)[0] / count)) < math.log(ngram_model.SCALE) + 1e-6


# ------------------------------------------------------------- 4 packing


@here
def test_packing_is_a_round_trip(spark, small):
    from tokenizers import Tokenizer

    tool = Tokenizer.from_file(packing.tokenizer_path())
    want = {d: [*tool.encode(r.text, add_special_tokens=False).ids, 1] for d, r in small.items()}
    rows = packing.pack(spark.read.parquet(f"{SMALL}/documents.parquet")).collect()
    back: dict[int, list] = {d: [] for d in small}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        assert r.start == len(back[r.doc_id]) and r.length == len(r.ids) and r.doc_tokens == len(want[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        back[r.doc_id] += r.ids
    assert back == want
    by = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == by.get(r.sequence_id, 0)
        by[r.sequence_id] = r.offset + r.length
    assert all(n == 2048 for s, n in by.items() if s != max(by)) and sorted(by) == list(range(len(by)))


def test_words_with_the_mark_are_encoded_alone():
    tool = packing.WordTokenizer(packing.tokenizer_path())
    texts = ["a|b c | d", "it's 12 | x", "", "Ünï'll ###"]
    ids, off = tool.encode(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(off, off[1:])] == [tool.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


# ------------------------------------------------------------- 5 quality


def test_cascade_equals_all_rules(spark):
    rng = random.Random(5)
    texts = [sentences(rng, rng.randint(0, 30)) for _ in range(80)] + ["A! " * 60, "x y z " * 40, "\n".join(["same line here"] * 9), "#a *b $c " * 20, "ok " * 3] + [""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.kept for r in quality.quality_cascade(df).collect()}
    for i, t in enumerate(texts):
        lazy = quality._Lazy(pa.array([t]))
        assert got[i] == (not any(rule.rejects(lazy.all)[0] for rule in quality.RULES)), t[:40]
    shuffled = list(reversed(quality.RULES))
    assert {r.doc_id: r.kept for r in quality.quality_cascade(df, order=shuffled).collect()} == got
    assert {r.doc_id for r in quality.keep_good(df).collect()} == {i for i, k in got.items() if k}


@here
@pytest.mark.parametrize("name", list(ORACLES))
def test_oracles(spark, name):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "embeddings"):
        c.execute(f"create view {t} as select * from read_parquet('{SMALL}/{t}.parquet')")
    want = c.sql(ORACLES[name])
    got = QUERIES[name](spark, SMALL).select(want.columns)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want.fetchall()))


# ------------------------------------------------------------- 6 toxicity


def test_machine_learns_interactions(spark):
    rng = random.Random(6)
    rows, marks = [], []
    for i in range(600):
        words = [rng.choice(VOCAB[:60]) for _ in range(12)]
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        words += ["dreadful"] * insult + ["villagers"] * group
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
        marks.append((i, int(insult and group)))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int")
    model = toxicity.train(docs.where("doc_id < 450"), labels.where("doc_id < 450"))
    got = {r.doc_id: r.predicted for r in toxicity.score(docs.where("doc_id >= 450"), model).collect()}
    assert sum(got[i] == y for i, y in marks[450:]) >= 0.95 * 150


def test_machine_score_is_the_sum_over_pairs():
    rng = np.random.default_rng(1)
    column = np.full(1 << toxicity.BUCKET_BITS, -1, np.int32)
    text = pa.array(["alpha beta gamma alpha", ""])
    _, bucket, _ = toxicity._terms(text)
    known = np.unique(bucket)[:5]
    column[known] = np.arange(len(known))
    m = toxicity.FactorMachine(column, 0.3, rng.normal(size=5), rng.normal(size=(5, 4)))
    raw = 0.3 + m.weight.sum() + sum(m.factor[i] @ m.factor[j] for i, j in itertools.combinations(range(5), 2))
    assert m.score(text) == pytest.approx([1 / (1 + math.exp(-raw)), 1 / (1 + math.exp(-0.3))])


# ------------------------------------------------------------- 7 mixing


def test_targets():
    assert mixing.targets([10, 10, 10], [3, 1, 2], 45) == [20, pytest.approx(25 / 3), pytest.approx(50 / 3)]
    assert mixing.targets([0, 5], [3, 1], 7.5) == [0, 7.5] and mixing.targets([], [], 0) == []


@pytest.mark.parametrize("shards", [1, 2, 5, 16])
def test_split_tree_keeps_quotas(shards):
    q = np.array([7, 0, 40, 3])
    leaves = list(mixing.split_tree(0, shards, np.zeros_like(q), q, 2))
    assert [lo for lo, *_ in leaves] == list(range(shards)) and all(hi == lo + 1 for lo, hi, *_ in leaves)
    s = np.array([quota for *_, quota in leaves])
    assert (s.sum(axis=0) == q).all() and (s >= 0).all() and np.ptp(s.sum(axis=1)) <= shards
    assert (np.array([first for *_, first, _ in leaves]) == np.cumsum(s, axis=0) - s).all()  # runs are disjoint and leave nothing out
    top = list(mixing.split_tree(0, shards, np.zeros_like(q), q, 2, 3))
    below = [leaf for lo, hi, first, quota in top for leaf in mixing.split_tree(lo, hi, first, quota, 2)]
    assert [x[3].tolist() for x in below] == s.tolist()


def test_the_mix_comes_from_the_leaves_of_the_tree(spark, monkeypatch):
    df = spark.createDataFrame([(i, "one two three", "ab"[i % 2]) for i in range(400)], "doc_id long, text string, source string")
    assert sum(r.taken for r in mixing.mix_counts(df, shards=4).collect()) == 1800
    real = mixing.split_tree

    def first_only(*args):
        return [x if x[0] == 0 else (*x[:3], np.zeros_like(x[3])) for x in real(*args)]

    monkeypatch.setattr(mixing, "split_tree", first_only)
    got = mixing.mix_counts(df, shards=4).collect()
    assert {s for r in got for s in r.shards} == {0} and 0 < sum(r.taken for r in got) < 700


@here
def test_mixing_query(spark, small):
    rows = {r.doc_id: r for r in QUERIES["op7_mixing"](spark, SMALL).collect()}
    assert rows.keys() == small.keys()
    size, taken = Counter(), Counter()
    for d, r in rows.items():
        assert r.size == len(WORD.findall(small[d].text or "")) and r.taken == r.size * len([x for x in r.shards.split(",") if x]) <= 2 * r.size
        size[small[d].source] += r.size
        taken[small[d].source] += r.taken
    names = sorted(size)
    left, free, want = 1.5 * sum(size.values()), dict(zip(names, [3, 1, 2] * len(names))), {}
    while True:
        share = {s: left * w / sum(free.values()) for s, w in free.items()}
        full = [s for s in free if share[s] > 2 * size[s]]
        if not full:
            break
        for s in full:
            want[s] = 2 * size[s]
            left -= want[s]
            del free[s]
    want |= share
    longest = max(r.size for r in rows.values())
    for d, r in rows.items():
        s = small[d].source
        assert r.target == pytest.approx(want[s]) and r.source_size == size[s] and abs(taken[s] - want[s]) <= longest


def test_mix_reaches_targets_and_reruns_agree(spark):
    rng = random.Random(7)
    rows = [(i, sentences(rng, rng.randint(1, 6)), rng.choice([None, "a", "a", "a", "b", "ü"])) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix_counts(df).collect()
    again = mixing.mix_counts(df.repartition(7)).collect()
    assert sorted((r.doc_id, r.taken, tuple(r.shards)) for r in got) == sorted((r.doc_id, r.taken, tuple(r.shards)) for r in again)
    by = {}
    for r in got:
        src = rows[r.doc_id][2]
        assert r.size == len(rows[r.doc_id][1].split()) and r.taken in (0, r.size, 2 * r.size)
        t = by.setdefault(src, [r.target, 0, r.source_size, 0])
        t[1] += r.taken
        t[3] += r.size
    assert all(abs(t - taken) < 0.01 * t + 20 and total == size for t, taken, total, size in by.values())
    assert sum(t for t, *_ in by.values()) == pytest.approx(1.5 * sum(r.size for r in got))
    copies = Counter(r.doc_id for r in mixing.mix(df).collect())
    assert copies == Counter({r.doc_id: len(r.shards) for r in got if r.shards})


# ------------------------------------------------------------- 8 licenses


def longest_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        corner = 0
        for j, y in enumerate(b):
            corner, row[j + 1] = row[j + 1], corner + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 12), max_size=25), st.lists(st.integers(0, 12), max_size=25))
def test_alignment_is_a_common_subsequence(a, b):
    pairs = license_scan.align(a, b)
    assert all(a[i] == b[j] for i, j in pairs) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
    assert len(pairs) <= longest_common(a, b)
    if len(set(a)) == len(a) and len(set(b)) == len(b):
        assert len(pairs) == longest_common(a, b)


def test_licenses_are_found_in_place(spark):
    mit = license_scan.TEMPLATES["MIT"][2]
    noisy = mit.upper().replace("free of charge", "for free").replace(",", " ;")
    rows = [(1, f"Some code.\n{noisy}\nMore."), (2, "Licensed under CC BY-NC 4.0."), (3, "free software licensed words under the sun"), (4, "x " * 500 + "Released under the MIT License." + " y" * 500)]
    got = {r.doc_id: r for r in license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    hit = next(f for f in got[1].found if f.license == "MIT" and f.template == 2)
    assert hit.coverage > 0.9 and rows[0][1][hit.first_byte : hit.end_byte].startswith("PERMISSION") and got[3].n_found == 0
    assert max(got[2].found, key=lambda f: (f.coverage, f.words)).license == "CC-BY-NC-4.0"
    best = next(f for f in got[4].found if f.coverage == 1)
    assert rows[3][1][best.first_byte : best.end_byte] == "Released under the MIT License"


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 9), min_size=1, max_size=12), st.lists(st.integers(0, 12), max_size=60), st.integers(1, 12))
def test_windows_hold_every_place_that_may_do(a, b, least):
    least, reach = min(least, len(a)), max(8, 2 * len(a))
    places = [j for j, x in enumerate(b) if x in a]
    items = [b[j] for j in places]
    found = list(license_scan.windows(a, items, places, least))
    most = max((longest_common(a, b[j : j + reach]) for j in places), default=0)
    assert max((longest_common(a, items[lo:hi]) for lo, hi, _ in found), default=0) == (most if most >= least else 0)
    for lo, hi, bound in found:
        assert places[hi - 1] - places[lo] < reach and bound >= longest_common(a, items[lo:hi])


@settings(max_examples=100, deadline=None)
@given(st.integers(0, 10**6))
def test_copies_with_a_few_changes_are_covered_as_by_the_longest_common_words(seed):
    """Templates of mostly different words, copied with words left out, put in or changed, some of them twice."""
    rng = random.Random(seed)
    a = [rng.randrange(40) for _ in range(rng.randint(8, 40))]
    b = [rng.randrange(100, 140) for _ in range(20)]
    for _ in range(rng.randint(1, 3)):
        copy = [x for x in a if rng.random() > 0.04]
        for _ in range(rng.randint(0, 2)):
            copy.insert(rng.randrange(len(copy) + 1), rng.randrange(100, 140))
        b += copy + [rng.randrange(100, 140) for _ in range(rng.randint(0, 30))]
    text = " ".join(f"w{x}" for x in b)
    found = license_scan._Scanner({"x": [" ".join(f"w{x}" for x in a)]}, 0.8).scan(pa.array([text]))[0]
    reach = max(8, 2 * len(a))
    most = max(longest_common(a, b[j : j + reach]) for j in range(len(b)))
    if most >= 0.8 * len(a):
        assert found and found[0]["words"] >= max(0.8 * len(a), most - 1)
    else:
        assert not found


def test_nothing_is_found_without_alignment(monkeypatch):
    scanner = license_scan._Scanner(license_scan.TEMPLATES, 0.8)
    texts = pa.array(["Released under the MIT License. " * k for k in (1, 2, 5)])
    assert all(scanner.scan(texts))
    monkeypatch.setattr(license_scan, "align", lambda a, b: [])
    assert not any(scanner.scan(texts))


def test_templates_may_come_from_files(spark, tmp_path):
    (tmp_path / "Own-1.0.txt").write_text("You may do with this work as you like, but tell me of it.")
    (tmp_path / "Other").write_text("All rights to this one are kept by those who made it.")
    templates = license_scan.read_templates(spark, str(tmp_path))
    rows = spark.createDataFrame([(1, "x you may do with this work as you like but tell me of it y"), (2, "no")], "doc_id long, text string")
    got = {r.doc_id: [x.license for x in r.found] for r in license_scan.scan_licenses(rows, templates=templates).collect()}
    assert list(templates) == ["Other", "Own-1.0"] and got == {1: ["Own-1.0"], 2: []}


def test_a_repeated_notice_is_found(spark):
    short, mit = "Released under the MIT License", license_scan.TEMPLATES["MIT"][2]
    rows = [(1, f"the code {short}. {short}. See the file"), (2, f"the and of {mit} and the of {mit} the of and " + "the x of " * 200)]
    got = {r.doc_id: r for r in license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    hit = next(f for f in got[1].found if f.template == 0)
    assert hit.coverage == 1 and rows[0][1][hit.first_byte : hit.end_byte] == short
    hit = next(f for f in got[2].found if f.template == 2)
    assert hit.coverage == 1 and rows[1][1][hit.first_byte : hit.end_byte] == mit[:-1]


def _lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def test_every_template_is_found_twice_amid_noise(spark):
    rng = random.Random(3)
    rows, names = [], []
    for name, texts in license_scan.TEMPLATES.items():
        for k, t in enumerate(texts):
            noise = [" ".join(rng.choice(VOCAB) for _ in range(12)) for _ in range(3)]
            rows.append((len(rows), f"{noise[0]} {t} {noise[1]} {t} {noise[2]}"))
            names.append((name, k))
    rows += [(len(rows) + i, sentences(rng, 30)) for i in range(20)]
    got = {r.doc_id: r.found for r in license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, (name, k) in enumerate(names):
        assert [x.coverage for x in got[i] if (x.license, x.template) == (name, k)] == [1.0], (name, k)
    assert not any(got[i] for i in range(len(names), len(rows)))


@here
def test_license_query_against_the_best_window(spark, small):
    """A template is found if and only if some window of the text, of twice its length, has enough of its words in order."""
    short = [(n, w) for n, ts in license_scan.TEMPLATES.items() for t in ts if len(w := re.findall(r"[a-z0-9\x80-\U0010ffff]+", t.lower())) <= 12]
    rows = {r.doc_id: r for r in QUERIES["op8_license"](spark, SMALL).collect()}
    assert rows.keys() == small.keys()
    full = {r.doc_id: {x.license for x in r.found} for r in license_scan.scan_licenses(spark.read.parquet(f"{SMALL}/documents.parquet")).collect()}
    for d, r in small.items():
        words = re.findall(r"[a-z0-9\x80-\U0010ffff]+", lower(r.text or ""))
        for name, t in short:
            at = [i for i, w in enumerate(words) if w in set(t)]
            reach = max(8, 2 * len(t))
            best = max((_lcs(t, words[i : i + reach]) for i in at), default=0) if len(set(words) & set(t)) >= 0.5 * len(t) else 0
            if best >= 0.8 * len(t):
                assert name in full[d]
        assert rows[d].n_found >= len(full[d]) and (rows[d].license in full[d] if full[d] else rows[d].license is None)


# ------------------------------------------------------------- 9 Jaccard


def shingle_set(text):
    w = WORD.findall(lower(text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def plain_components(docs):
    sets = {d: shingle_set(t) for d, t in docs}
    label = {d: d for d, _ in docs}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        k = len(sets[a] & sets[b])
        if k and 100 * k >= 80 * (len(sets[a]) + len(sets[b]) - k):
            x, y = sorted((root(a), root(b)))
            label[y] = x
    return {d: (len(sets[d]), root(d)) for d in sets}


def test_jaccard_equals_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    rng = random.Random(9)
    docs = []
    for g in range(12):
        base = [rng.choice(VOCAB) for _ in range(rng.randint(3, 120))]
        for _ in range(rng.choice([1, 2, 30])):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 25))):
                copy[rng.randrange(len(copy))] = rng.choice(VOCAB)
            docs.append((len(docs), " ".join(copy)))
    docs += [(len(docs), ""), (len(docs) + 1, "one two"), (len(docs) + 2, "One  TWO")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
    want = plain_components(docs)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(df).collect()} == want
    assert sorted(r.doc_id for r in jaccard.keep_one(df).collect()) == sorted({c for _, c in want.values()})


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, 400), min_size=1, max_size=120), st.sets(st.integers(0, 400), min_size=1, max_size=120))
def test_bitmaps_bound_the_overlap(a, b):
    arrays = [np.sort(_text.mix(np.array(sorted(s), np.uint64))) for s in (a, b)]
    maps = [jaccard._bitmaps(np.zeros(len(x), np.int64), x, np.array([len(x)]))[0] for x in arrays]
    most = jaccard.overlap_bound(len(a), maps[0], len(b), maps[1])
    exact = jaccard.overlap(arrays[0].tobytes(), arrays[1].tobytes())
    assert exact == len(a & b) <= most <= min(len(a), len(b))
    assert (100 * exact >= 80 * (len(a) + len(b) - exact)) == (exact >= jaccard.need(len(a), len(b)))


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 340)] + [(500, k) for k in range(501, 560)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    label = {}

    def root(x):
        label.setdefault(x, x)
        return x if label[x] == x else root(label[x])

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        if a != b:
            label[y] = x
    assert got == {x: root(x) for a, b in edges for x in (a, b) if any(a != b and x in (a, b) for a, b in edges)}


# ------------------------------------------------------------- 10 language


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(10)
    counts = np.array([3, 0, 6, 1])
    ptr = np.concatenate([[0], np.cumsum(counts)])
    e = rng.normal(size=(10, 3))
    got = language.viterbi(e, counts, ptr, 0.8)
    for d in range(4):
        part = e[ptr[d] : ptr[d + 1]]
        paths = itertools.product(range(3), repeat=len(part))
        value = lambda p: sum(part[i][s] for i, s in enumerate(p)) - 0.8 * sum(a != b for a, b in zip(p, p[1:]))
        assert value(got[ptr[d] : ptr[d + 1]]) == pytest.approx(max(map(value, paths)))


def test_scripts_narrow_and_spans_follow(spark):
    train = [("en", "the quick brown fox jumps over the lazy dog and then the cat"), ("fr", "le renard brun saute par dessus le chien et puis le chat noir"), ("ru", "быстрая лиса прыгает через ленивую собаку и кота")]
    rows = [(i, k, t) for i, (k, t) in enumerate(train * 4)]
    model = language.train(spark.createDataFrame(rows, "doc_id long, lang string, text string"), "text", "lang")
    tests = [(0, "the dog and the fox"), (1, "лиса и кот"), (2, "the quick fox and the dog jumps over " * 3 + "le chien et le chat noir saute par dessus " * 3), (3, "12 — !"), (4, "λέξη")]
    got = {r.doc_id: r for r in language.identify(spark.createDataFrame(tests, "doc_id long, text string"), model).collect()}
    assert got[0].lang_pred == "en" and got[1].lang_pred == "ru" and got[3].lang_pred == "und" and got[4].lang_pred in model.langs
    assert [s.lang for s in got[2].spans] == ["en", "fr"] and got[2].spans[0].first_byte == 0


def test_only_texts_without_letters_are_undetermined(spark):
    rows = [("the cat sat on the mat and the dog", "en"), ("der hund und die katze sind nicht hier", "de")] * 20
    model = language.train(spark.createDataFrame(rows, "text string, lang string"), "text", "lang")
    letters = ["ⲁⲃⲅⲇ", "ㄅㄆㄇ ㄈㄉ", "ꀀꀁꀂ", "ꕉꕜ", "ꦲꦏ", "שּׁ", "ﺀﺎﺏ", "𐤀𐤁", "ⵣⵓ", "the ꀀꀁ cat and the dog"]
    others = ["", "1234 .,", "\u0301\u0302", "٠١٢", "→ ☃ 😀", "〈〉"]
    docs = spark.createDataFrame(list(enumerate(letters + others)), "doc_id long, text string")
    got = {r.doc_id: r for r in language.identify(docs, model).collect()}
    assert all((got[i].lang_pred == "und") == (i >= len(letters)) for i in got) and got[len(letters) - 1].lang_pred == "en"


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=8))
def test_letters_are_those_of_unicode(text):
    t = language.Letters(pa.array([text]))
    assert int(t.letters.sum()) == sum(c.isalpha() and ord(c) < 0x34000 for c in text)


@here
def test_held_out_accuracy(spark, small):
    rows = QUERIES["op10_language"](spark, SMALL).collect()
    assert rows and all((r.lang_pred == "und") == (not any(c.isalpha() for c in small[r.doc_id].text or "")) and (r.spans == "[]") == (r.lang_pred == "und") for r in rows)
    rows = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == small[r.doc_id].lang for r in rows) >= 0.95 * len(rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
