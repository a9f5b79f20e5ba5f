"""Periodic runs, vector codes and resharding against plain versions, with their edge cases."""

import functools
import hashlib
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gristmill.llm import periodic, resharding, vector_codes
from gristmill.llm._text import Words
from gristmill.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"
here = pytest.mark.skipif(not os.path.isdir(SMALL), reason="the driver's tables are not here")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


# ---------------------------------------------------------- 11 periodic runs


def plain_runs(ws):
    """(start, length, period) of every run, by comparing words at every distance."""
    n, out = len(ws), {}
    for d in range(1, n // 3 + 1):
        i = 0
        while i + d < n:
            j = i
            while j + d < n and ws[j] == ws[j + d]:
                j += 1
            if j > i and j + d - i >= max(24, 3 * d):
                out.setdefault((i, j + d - i), d)
            i = max(j, i + 1)
    return sorted(((s, n, q) for (s, n), q in out.items()), key=lambda r: (r[0], r[2]))


def found_runs(texts):
    w = Words(pa.array(texts), lower=False)
    out = defaultdict(list)
    for t, s, n, q in zip(*(x.tolist() for x in periodic.find_runs(w.key, w.counts))):
        out[t].append((s, n, q))
    return [out[i] for i in range(len(texts))]


def planted(rng, n, kinds, times):
    ws = [f"w{rng.randrange(kinds)}" for _ in range(n)]
    for _ in range(times if n > 10 else 0):
        a = rng.randrange(n)
        p, size = rng.randint(1, max(1, (n - a) // 2)), rng.randint(1, n - a)
        for i in range(a, a + size):
            ws[i] = ws[a + (i - a) % p]
    return " ".join(ws)


def test_transform_is_exact_and_undone():
    rng = np.random.default_rng(5)
    for n in (16, 128, 256, 4096, 32768):
        x = rng.integers(0, periodic.PRIME, (2, n)).astype(float)
        back = periodic.backward(periodic.transform(x)) * pow(n, -1, periodic.PRIME) % periodic.PRIME
        assert (back == x).all()


@pytest.mark.parametrize("width", [8, 64, 512])
def test_squared_differences_equal_their_sums(width):
    v = np.random.default_rng(width).integers(0, periodic.PRIME, 6 * width).astype(float)
    got = periodic.squared_differences(v, np.array([0, width]), width, np.array([width, 2 * width]))
    for r, (b, f) in enumerate(((0, width), (width, 2 * width))):
        for e in range(0, width, max(1, width // 9)):
            assert got[r, e] == sum((int(v[b + k]) - int(v[b + f + e + k])) ** 2 for k in range(width)) % periodic.PRIME


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**9))
def test_runs_equal_all_distances(seed):
    rng = random.Random(seed)
    texts = [planted(rng, rng.choice([0, 5, 23, 24, 25, 70, 200, 400]), rng.choice([1, 2, 3, 5, 40]), rng.randint(0, 4)) for _ in range(rng.randint(1, 5))]
    assert found_runs(texts) == [plain_runs(t.split()) for t in texts]


def test_runs_of_every_period_and_of_special_texts():
    texts = []
    for q in range(1, 70):
        period = [f"p{q}x{i}" for i in range(q)]
        length = max(24, 3 * q)
        for shift in (0, 3, 8):
            texts.append(" ".join([f"a{i}" for i in range(shift)] + [period[i % q] for i in range(length)] + ["end", "of", "it"]))
            texts.append(" ".join(period[i % q] for i in range(length - 1)))
    a, b = [0], [1]
    for _ in range(9):
        a, b = a + b, b + a  # the word of Thue and Morse, on which wrapping polynomial hashes collide
    texts += [" ".join(map(str, a + b + a)), " ".join(map(str, (a + b) * 3)), "a " * 3000, ("a " * 300 + "b ") * 9]
    assert found_runs(texts) == [plain_runs(t.split()) for t in texts]


def test_zeros_are_the_only_way_to_a_run(monkeypatch):
    text = [" ".join(f"x{i % 20}" for i in range(100))]
    assert found_runs(text) == [[(0, 100, 20)]]
    monkeypatch.setattr(periodic, "squared_differences", lambda values, block, width, first: np.ones((len(block), width)))
    assert found_runs(text) == [[]]


def test_long_blocks_are_sought_by_their_first_words(monkeypatch):
    monkeypatch.setattr(periodic, "MOST_BLOCK", 16)
    rng = random.Random(2)
    texts = [planted(rng, 600, 9, 3) for _ in range(20)] + [" ".join(f"x{i % 111}" for i in range(400))]
    assert found_runs(texts) == [plain_runs(t.split()) for t in texts]


def test_short_least_runs_are_refused():
    with pytest.raises(ValueError):
        periodic.find_runs(np.zeros(0, np.uint64), np.zeros(0, np.int64), 10, 3)


LONG = "one two three four five. " * 60000


@pytest.fixture(scope="module")
def odd_docs(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "na na " * 30), (4, "na na " * 30), (None, "word " * 24), (None, None), (5, LONG), (6, "naïve 東京 𝒳 " * 20), (7, "Ein Wort " * 5)]
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], "doc_id long, text string, runs string, n_words string, k0 string").repartition(3).cache()


def test_periodic_edges(odd_docs):
    got = periodic.periodic_runs(odd_docs, keep=("doc_id", "runs", "k0")).toDF("doc_id", "own", "k0", "n_words", "runs", "collapsed").collect()
    assert len(got) == 10 and {r.own for r in got} == {"x"}
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append((r.n_words, [tuple(x) for x in r.runs], r.collapsed))
    assert by[1] == by[2] == by[3] == [(0, [], "")] and by[4] == [(60, [(0, 60, 1)], "na")] * 2
    assert sorted(by[None]) == [(0, [], ""), (24, [(0, 24, 1)], "word")]
    assert by[5] == [(300000, [(0, 300000, 5)], "one two three four five.")] and by[6] == [(60, [(0, 60, 3)], "naïve 東京 𝒳")]
    assert by[7] == [(5, [], " ".join(["Ein Wort"] * 5))]
    assert periodic.periodic_runs(odd_docs.where("false")).count() == 0


@here
def test_op11_equals_plain_python(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = QUERIES["op11_periodic"](spark, SMALL).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    for r in got:
        ws = WORD.findall(docs[r.doc_id] or "")
        h, n = zlib.crc32(str(r.doc_id).encode()), len(ws)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            ws = ws[:a] + [ws[a + (i - a) % p] for i in range(a, n)]
        runs = plain_runs(ws)
        best = min(runs, key=lambda x: (-x[1] / x[2], x[0], x[2])) if runs else (None,) * 3
        gone = {i for s, size, q in runs for i in range(s + q, s + size)}
        lines = "".join(f"{s},{size},{q}\n" for s, size, q in runs)
        kept = " ".join(w for i, w in enumerate(ws) if i not in gone)
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert (r.runs_sha256, r.collapsed_sha256) == tuple(hashlib.sha256(x.encode()).hexdigest() for x in (lines, kept))


# ---------------------------------------------------------- 12 vector codes


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 9), st.integers(1, 28), st.integers(0, 10**6))
def test_products_of_limbs_are_exact(width, bits, seed):
    rng = np.random.default_rng(seed)
    a, b = rng.integers(-(1 << bits), (1 << bits) + 1, (7, width)), rng.integers(-(1 << bits), (1 << bits) + 1, (width, 5))
    assert vector_codes.dots(a, b).tolist() == (a.astype(object) @ b.astype(object)).tolist()
    assert all((np.abs(x) < 2.0**12 + 1).all() for x in vector_codes.limbs(a, 12))
    assert sum(x.astype(np.int64) << (12 * k) for k, x in enumerate(vector_codes.limbs(a, 12))).tolist() == a.tolist()


def plain_codes(rows, parts=16, entries=64, rounds=2):
    """rows of (id, integers), by id -> (codes and errors, codebooks) in Python's integers."""
    step = len(rows[0][1]) // parts
    cut = [[v[p * step : (p + 1) * step] for p in range(parts)] for _, v in rows]
    books = [[cut[i][p] for i in range(min(entries, len(rows)))] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            groups = defaultdict(list)
            for c in cut:
                groups[near(c[p], books[p])[1]].append(c[p])
            books[p] = [[sum(x) // len(groups[e]) for x in zip(*groups[e])] if e in groups else old for e, old in enumerate(books[p])]
    best = [[near(c[p], books[p]) for p in range(parts)] for c in cut]
    return ["".join(f"{e:02x}" for _, e in b) for b in best], [sum(d for d, _ in b) for b in best], books


def test_codes_equal_plain_integers(spark):
    rng = random.Random(8)
    for most in (3.0, 200.0, 120000.0):  # the last need more than one limb
        rows = [(i, [rng.choice([rng.uniform(-most, most), most]) for _ in range(32)], rng.choice(["a", "b", None])) for i in range(150)]
        vectors = vector_codes.whole_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string").repartition(5))
        books = vector_codes.fit_codebooks(vectors)
        got = {r.vec_id: (r.code, r.error) for r in vector_codes.encode(vectors, books).collect()}
        codes, errors, plain = plain_codes([(i, [int(np.floor(256 * x)) for x in v]) for i, v, _ in rows])
        assert [got[i] for i in range(150)] == list(zip(codes, errors)) and books.entries.tolist() == plain


def test_vector_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(3, [0.5, -0.5], "a"), (1, [1.0, 2.0], None), (1, [1.0, 2.0], "a"), (None, [9.0, 9.0], None), (4, None, "a"), (5, [None, 1.0], "a"), (6, [nan, 1.0], "b"), (7, [inf, 1.0], "b"), (8, [-inf, 0.0], "b"), (9, [], "c"), (10, [1.0, 2.0, 3.0], "c")]
    table = spark.createDataFrame([(*r, "x", "y") for r in rows], "vec_id long, embedding array<float>, of string, n string, hot string")
    vectors = vector_codes.whole_vectors(table)
    books = vector_codes.fit_codebooks(vectors, parts=2, entries=3)
    assert books.entries.tolist() == [[[256], [256], [128]], [[512], [512], [-128]]] or books.width == 2
    coded = vector_codes.encode(vectors, books, keep=("vec_id", "of", "n", "hot"))
    got = vector_codes.with_label_errors(coded, "of").collect()
    assert len(got) == 6 and {r.n for r in got} == {"x"}
    sums = {r.of: r.label_error for r in got}
    assert sums["a"] == sum(r.error for r in got if r.of == "a") and sums[None] == sum(r.error for r in got if r.of is None) and sums["c"] is None
    assert {(r.code, r.error) for r in got if r.vec_id in (9, 10)} == {(None, None)}
    none = vector_codes.whole_vectors(table.where("false"))
    assert vector_codes.fit_codebooks(none) is None
    with pytest.raises(ValueError):
        vector_codes.fit_codebooks(vectors, parts=16)


def test_label_errors_of_many_and_few(spark, monkeypatch):
    rows = [(i, "c", i, None if i % 7 == 0 else "hot" if i % 3 else f"l{i}") for i in range(400)]
    coded = spark.createDataFrame(rows, "vec_id long, code string, error long, label string")
    want = defaultdict(int)
    for _, _, e, label in rows:
        want[label] += e
    for share in (0.1, 1e-9, 1.0):
        monkeypatch.setattr(vector_codes, "HOT_SHARE", share)
        got = vector_codes.with_label_errors(coded).collect()
        assert len(got) == 400 and all(r.label_error == want[r.label] for r in got)


@here
def test_op12_of_an_empty_table(spark, tmp_path):
    spark.read.parquet(f"{SMALL}/embeddings.parquet").where("false").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert QUERIES["op12_vector_codes"](spark, str(tmp_path)).count() == 0


# ---------------------------------------------------------- 13 resharding


def least_cost(supplies, capacities, cost):
    """The least cost of any shipment, by trying all."""

    @functools.cache
    def ship(i, room):
        return min(split(i, 0, supplies[i], room), default=10**9) if i < len(supplies) else 0

    def split(i, j, left, room):
        if j == len(room):
            if not left:
                yield ship(i + 1, room)
            return
        for x in range(min(left, room[j]) + 1):
            for rest in split(i, j + 1, left - x, (*room[:j], room[j] - x, *room[j + 1 :])):
                yield x * int(cost[i][j]) + rest

    return ship(0, tuple(capacities))


@settings(max_examples=80, deadline=None)
@given(st.data())
def test_flow_costs_least(data):
    n, m = data.draw(st.integers(1, 3)), data.draw(st.integers(1, 3))
    supplies = data.draw(st.lists(st.integers(0, 4), min_size=n, max_size=n))
    capacities = data.draw(st.lists(st.integers(0, 5), min_size=m, max_size=m))
    cost = np.array(data.draw(st.lists(st.lists(st.integers(0, 6), min_size=m, max_size=m), min_size=n, max_size=n)))
    if sum(supplies) > sum(capacities):
        with pytest.raises(ValueError):
            resharding.min_cost_flow(supplies, capacities, cost)
        return
    flow = resharding.min_cost_flow(supplies, capacities, cost)
    assert flow.sum(1).tolist() == supplies and (flow.sum(0) <= capacities).all() and (flow >= 0).all()
    assert (flow * cost).sum() == least_cost(tuple(supplies), capacities, cost)


def test_flow_moves_only_what_must_move():
    supplies = [900, 100, 0, 500]
    for shards in (2, 4, 7):
        c = resharding.even_capacities(sum(supplies), shards)
        flow = resharding.min_cost_flow(supplies, c, resharding.staying_is_free(4, shards))
        assert flow.sum() - np.trace(flow) == sum(max(0, s - (c[i] if i < shards else 0)) for i, s in enumerate(supplies))


def check_slots(rows):
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


@here
def test_op13_is_even_and_moves_least(spark):
    docs = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = QUERIES["op13_resharding"](spark, SMALL).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    assert all((r.size, r.text_crc32) == (len(docs[r.doc_id]) + 1, zlib.crc32(docs[r.doc_id])) for r in got)
    assert {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None}
    check_slots(got)
    old, new, moved = defaultdict(int), defaultdict(int), 0
    for r in got:
        assert r.old_shard == zlib.crc32(str(r.doc_id).encode()) % 6
        old[r.old_shard] += r.size
        new[r.shard] += r.size
        moved += r.size * (r.shard != r.old_shard)
    total, largest = sum(new.values()), max(r.size for r in got)
    assert all(abs(new[k] - total / 8) <= 6 * largest / 2 + 1 for k in range(8))
    least = sum(max(0, n - total // 8) for n in old.values())
    assert abs(moved - least) <= 8 * largest
    again = QUERIES["op13_resharding"](spark, SMALL).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_reshard_edges(spark, odd_docs):
    from pyspark.sql import functions as F

    got = resharding.reshard(odd_docs, F.lit(0), 1, 3).collect()
    assert len(got) == 10 and sorted(r.size for r in got if r.doc_id in (1, 2)) == [1, 1]
    check_slots(got)
    assert resharding.reshard(odd_docs.where("false"), F.lit(0), 1, 3).count() == 0
    same = spark.range(3000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("same text").alias("text"))
    got = resharding.reshard(same.repartition(4), F.lit(1), 2, 4).collect()
    check_slots(got)
    count = defaultdict(int)
    for r in got:
        count[r.shard] += 1
    assert sorted(count.values()) == [750] * 4


def test_reshard_stores_whole_documents_in_their_shards(spark, odd_docs, tmp_path):
    from pyspark.sql import functions as F

    more = odd_docs.withColumns({"a b.c": F.array(F.lit(1), F.lit(None)), "shard": F.lit("replaced"), "size": F.lit("stays in the files")})
    folder = f"file://{tmp_path}/shards"
    got = resharding.reshard(more, F.coalesce(F.col("doc_id") % 2, F.lit(0)), 2, 3, folder=folder).collect()
    files = spark.read.parquet(folder).select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).collect()
    names = ["doc_id", "text", "runs", "n_words", "k0", "a b.c"]
    assert {r.size for r in files} == {"stays in the files"}
    assert Counter(str([r[c] for c in names]) for r in files) == Counter(str([r[c] for c in names]) for r in more.collect())
    assert sorted(str([r[c] for c in (*names, "old_shard", "shard", "slot")]) for r in files) == sorted(str([r[c] for c in (*names, "old_shard", "shard", "slot")]) for r in got)
    assert all((r.size, r.text_crc32) == (len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in got)
    for file in {r.file for r in files}:
        slots = [r.slot for r in sorted(files, key=lambda r: r.row) if r.file == file]
        assert slots == sorted(slots)
    resharding.rewrite(spark, folder, 2)
    assert Counter((r.doc_id, r.text) for r in spark.read.parquet(folder).collect()) == Counter((r.doc_id, r.text) for r in got)


@here
def test_op13_is_read_from_stored_shards(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = QUERIES["op13_resharding"](spark, SMALL)
    files = got.inputFiles()
    assert files and all(re.search(r"/shard=[0-7]/[^/]+$", f) for f in files)
    moved = spark.read.option("basePath", files[0].rsplit("/", 2)[0]).parquet(*files).collect()
    assert len(moved) == len(docs) and all(r[c] == docs[r.doc_id][c] for r in moved for c in docs[r.doc_id].asDict())
    assert {(r.doc_id, r.shard, r.slot) for r in moved} == {(r.doc_id, r.shard, r.slot) for r in got.collect()}


@pytest.mark.parametrize("old", [-1, 3, None])
def test_reshard_refuses_an_unknown_old_shard(spark, odd_docs, old):
    from pyspark.sql import functions as F

    with pytest.raises(ValueError):
        resharding.reshard(odd_docs, F.when(F.col("doc_id") == 5, F.lit(old).cast("int")).otherwise(0), 3, 2)


def stored(spark, folder):
    table = spark.read.parquet(folder).selectExpr("doc_id", "text", "shard", "_metadata.file_path AS file").collect()
    size = defaultdict(int)
    for r in table:
        size[r.shard] += len(r.text or "") + 1
    return sorted((r.doc_id, r.text) for r in table), size, {r.file for r in table}


def test_stored_shards_are_rewritten_where_needed(spark, tmp_path):
    folder = f"file://{tmp_path}/shards"
    rows = [(i, "t" * (i % 50), i % 3 if i % 5 else 0) for i in range(900)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, shard int")
    frame.repartition(6, "doc_id").write.partitionBy("shard").parquet(folder)
    before, _, files = stored(spark, folder)
    flow = resharding.rewrite(spark, folder, 5).collect()
    after, size, now = stored(spark, folder)
    assert after == before and len(size) == 5 and max(size.values()) - min(size.values()) <= 200
    assert len(files & now) >= 3  # most of what stays was not touched
    assert sum(r.bytes for r in flow) == sum(size.values())
    assert resharding.rewrite(spark, folder, 5) is not None and stored(spark, folder)[0] == before
    resharding.rewrite(spark, folder, 2)
    assert stored(spark, folder)[0] == before and set(stored(spark, folder)[1]) == {0, 1}
    assert not resharding.finish(spark, folder)


def test_a_broken_rewriting_is_completed_or_cleared(spark, tmp_path, monkeypatch):
    folder = f"file://{tmp_path}/shards"
    frame = spark.createDataFrame([(i, "t" * (i % 50), i % 2 * 2) for i in range(300)], "doc_id long, text string, shard int")
    frame.repartition(4, "doc_id").write.partitionBy("shard").parquet(folder)
    before = stored(spark, folder)[0]
    true_finish, calls = resharding.finish, []

    def broken(spark, folder):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("the driver is lost")
        return true_finish(spark, folder)

    monkeypatch.setattr(resharding, "finish", broken)
    with pytest.raises(RuntimeError):
        resharding.rewrite(spark, folder, 4)
    assert stored(spark, folder)[0] == before  # not begun
    assert true_finish(spark, folder) and not true_finish(spark, folder)
    after, size, _ = stored(spark, folder)
    assert after == before and len(size) == 4
    (tmp_path / "shards" / "_next").mkdir()
    assert true_finish(spark, folder) and stored(spark, folder)[0] == before
