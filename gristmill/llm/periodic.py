"""Periodic runs of words by block convolution at dyadic scales.

A run is a stretch of consecutive words with smallest period q and at least
max(24, 3 q) words that no neighbouring word extends keeping period q.  Words
become residues of a prime.  At scale B a text is cut into blocks of B words;
an exact integer number theoretic transform convolves each block with the
words after it, which gives the sum of squared differences at every distance
from B to 2 B - 1 (1 to 16 at the first scale, B = 8).  A run with a period in
that range holds a whole block and its next copy, as 2 B - 1 + q <= max(24, 3 q);
so every run has a zero at its scale.  A zero is a seed: it is extended both ways
at its distance by prefix hashes, and every stretch is compared word by word.

Two exact rules save transforms: a block with a pair of words that does not come
again within the window cannot occur there, and a block whose whole window lies
in a run known from a smaller scale could only find that run again.

The transforms are matrix products: the prime is below 2^23, so a float64 product
of 128 terms stays below 2^53.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._store import map_batches
from ._text import Words, _powers, mix, slabs

LEAST_WORDS = 24
LEAST_PERIODS = 3
FIRST_SCALE = 8
#: 7 * 2^20 + 1, which has roots of unity of every power of two up to 2^20; 3 generates its residues.
PRIME = 7 * (1 << 20) + 1
_GENERATOR = 3
#: The longest transform that is one matrix product: 128 * PRIME^2 < 2^53.
_RADIX = 128
#: Words of a block that are convolved at once; longer blocks are sought by their first words.
MOST_BLOCK = 1 << 16
#: Numbers in the windows that are transformed at once.
_AT_ONCE = 1 << 18


def _mod(x: np.ndarray) -> np.ndarray:
    """x mod PRIME, in place; x holds whole numbers below 2^53."""
    x -= np.floor(x * (1.0 / PRIME)) * PRIME
    x += (x < 0) * float(PRIME)
    x -= (x >= PRIME) * float(PRIME)
    return x


@functools.cache
def _roots(n: int, inverse: bool) -> np.ndarray:
    """The powers 0 .. n-1 of a root of unity of order n, or of its inverse."""
    w = pow(_GENERATOR, (PRIME - 1) // n, PRIME)
    w = pow(w, -1, PRIME) if inverse else w
    out = np.ones(n, np.int64)
    at = 1
    while at < n:
        out[at : 2 * at] = out[:at] * pow(w, at, PRIME) % PRIME
        at *= 2
    return out


@functools.cache
def _matrix(n: int, inverse: bool) -> np.ndarray:
    k = np.arange(n)
    return _roots(n, inverse)[np.outer(k, k) % n].astype(np.float64)


@functools.cache
def _twiddle(r: int, s: int, inverse: bool) -> np.ndarray:
    return _roots(r * s, inverse)[np.outer(np.arange(r), np.arange(s))].astype(np.float64)


def _parts(n: int) -> tuple[int, int]:
    r = 1 << min(7, (n.bit_length()) // 2)
    return r, n // r


def transform(x: np.ndarray) -> np.ndarray:
    """The number theoretic transform of every row, in an order that backward() undoes."""
    m, n = x.shape
    if n <= _RADIX:
        return _mod(x @ _matrix(n, False))
    r, s = _parts(n)
    out = _mod(np.matmul(_matrix(r, False), x.reshape(m, r, s)))
    out *= _twiddle(r, s, False)
    return transform(_mod(out).reshape(m * r, s)).reshape(m, n)


def backward(x: np.ndarray) -> np.ndarray:
    """The inverse of transform(), n times too large."""
    m, n = x.shape
    if n <= _RADIX:
        return _mod(x @ _matrix(n, True))
    r, s = _parts(n)
    out = backward(x.reshape(m * r, s)).reshape(m, r, s)
    out *= _twiddle(r, s, True)
    return _mod(np.matmul(_matrix(r, True), _mod(out))).reshape(m, n)


def squared_differences(values: np.ndarray, block: np.ndarray, width: int, first: np.ndarray) -> np.ndarray:
    """Sums over k < width of (values[b + k] - values[b + f + e + k])^2 mod PRIME.

    A row for each b of `block` and f of `first`, a column for each e < width;
    width is a power of two, values are residues and reach to every index used.
    """
    near = values[block[:, None] + np.arange(width)]
    far = values[(block + first)[:, None] + np.arange(2 * width)]
    flipped = np.zeros_like(far)
    flipped[:, :width] = near[:, ::-1]
    product = transform(flipped)
    product *= transform(far)
    cross = backward(_mod(product))[:, width - 1 : 2 * width - 1]
    squares = np.cumsum(_mod(far * far), axis=1)
    squares = np.concatenate([np.zeros((len(far), 1)), squares], axis=1)
    total = squares[:, width : 2 * width] - squares[:, :width]
    total += _mod(near * near).sum(axis=1)[:, None]
    cross *= float(2 * pow(2 * width, -1, PRIME) % PRIME)
    return _mod(_mod(total) + PRIME - _mod(cross))


class _Slab:
    """Words of several texts in one row of 64-bit keys, each text ended by a key of its own."""

    def __init__(self, key: np.ndarray, counts: np.ndarray):
        texts = np.arange(len(counts), dtype=np.int64)
        self.end = np.cumsum(counts + 1) - 1  # where each text's own key stands
        self.first = self.end - counts
        self.key = np.empty(len(key) + len(counts), np.uint64)
        word = np.ones(len(self.key), bool)
        word[self.end] = False
        self.key[word] = key
        self.key[self.end] = mix(texts.astype(np.uint64) + np.uint64(0x5851F42D4C957F2D))
        self.text = np.repeat(texts, counts + 1)
        self.n = len(self.key)

    def next_pair(self) -> np.ndarray:
        """How far each pair of words comes again; very large where it does not."""
        far = np.full(self.n, 1 << 40, np.int64)
        if self.n > 1:
            pair = mix(self.key[:-1] * np.uint64(0x9E3779B97F4A7C15) + self.key[1:])
            order = np.argsort(pair, kind="stable")
            again = np.flatnonzero(pair[order[1:]] == pair[order[:-1]])
            far[order[again]] = order[again + 1] - order[again]
        return far


class _Reach:
    """How far two places of a slab agree, by prefix hashes of its keys."""

    def __init__(self, key: np.ndarray):
        self.key = key
        self.power = _powers(len(key) + 1)
        self.sum = np.concatenate([np.zeros(1, np.uint64), np.cumsum(key * self.power[:-1])])

    def _equal(self, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
        return (self.sum[a + size] - self.sum[a]) * self.power[b - a] == self.sum[b + size] - self.sum[b]

    def _most(self, room: np.ndarray, equal) -> np.ndarray:
        size = np.zeros(len(room), np.int64)
        step = 1 << max(0, int(room.max(initial=0)).bit_length() - 1)
        while step:
            more = size + step
            fits = np.flatnonzero(more <= room)
            good = fits[equal(fits, more[fits])]
            size[good] = more[good]
            step >>= 1
        return size

    def stretches(self, a: np.ndarray, b: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, length) of the greatest stretch with period d around words a..b of each row, as the hashes have it."""
        back = self._most(a, lambda i, size: self._equal(a[i] - size, a[i] - size + d[i], size))
        on = self._most(len(self.key) - b - d, lambda i, size: self._equal(b[i], b[i] + d[i], size))
        return a - back, b + on + d - (a - back)

    def exact(self, start: int, length: int, d: int) -> Iterator[tuple[int, int]]:
        """The greatest stretches with period d within one that hashes gave, compared word by word; more than one if hashes were wrong."""
        key = self.key
        same = np.concatenate([[False], key[start : start + length - d] == key[start + d : start + length], [False]])
        for first, last in np.flatnonzero(same[1:] != same[:-1]).reshape(-1, 2).tolist():
            lo, hi = start + first, start + last
            while lo > 0 and key[lo - 1] == key[lo - 1 + d]:
                lo -= 1
            while hi + d < len(key) and key[hi] == key[hi + d]:
                hi += 1
            yield lo, hi + d - lo


def _known(runs: dict[tuple[int, int], int], most: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) by start of runs of a period of at most `most` and `least` words; none lies in another then."""
    found = sorted(k for k, q in runs.items() if q <= most and k[1] - k[0] >= least)
    both = np.array(found, np.int64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


def _inside(start: np.ndarray, end: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether words a..b of each row lie in one of the stretches."""
    if not len(start):
        return np.zeros(len(a), bool)
    at = np.searchsorted(start, a, "right") - 1
    return (at >= 0) & (b <= end[np.maximum(at, 0)])


def _seeds(values: np.ndarray, block: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """(block, distance) of the zeros of the squared differences."""
    width = min(scale, MOST_BLOCK)
    firsts = [1, 1 + scale] if scale == FIRST_SCALE else range(scale, 2 * scale, width)
    rows = max(1, _AT_ONCE // (2 * width))
    at, far = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for first in firsts:
        for lo in range(0, len(block), rows):
            part = block[lo : lo + rows]
            hit, e = np.nonzero(squared_differences(values, part, width, np.full(len(part), first)) == 0)
            at.append(part[hit])
            far.append(first + e)
    return np.concatenate(at), np.concatenate(far)


def find_runs(key: np.ndarray, counts: np.ndarray, least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> tuple[np.ndarray, ...]:
    """(text, start, length, period) of all runs of texts of `counts` words with these keys, by text, start and period.

    least_words and least_periods must not be below 24 and 3, for which the scales are made.
    """
    if least_words < LEAST_WORDS or least_periods < LEAST_PERIODS:
        raise ValueError(f"runs of fewer than {LEAST_WORDS} words or {LEAST_PERIODS} periods are not found")
    slab, most = _Slab(key, counts), int(counts.max(initial=0))
    runs: dict[tuple[int, int], int] = {}
    reach, values, scale = None, None, FIRST_SCALE
    again = slab.next_pair() if most >= least_words else None
    while most >= max(least_words, least_periods * scale):
        block = np.arange(0, slab.n - scale, scale, dtype=np.int64)
        # of the pairs that lie in a block, the one that comes again last
        farthest = np.maximum.reduceat(again, np.stack([block, block + scale - 1], 1).ravel())[::2] if len(block) else block
        inside = (farthest <= 2 * scale) & (block + 2 * scale <= slab.end[slab.text[block]] + scale * (scale == FIRST_SCALE))
        block = block[inside & (counts[slab.text[block]] >= max(least_words, least_periods * scale))]
        start, end = _known(runs, scale // 2, scale)
        block = block[~_inside(start, end, block, block + 3 * scale)]
        if len(block):
            if reach is None:
                reach = _Reach(slab.key)
                values = (slab.key % np.uint64(PRIME)).astype(np.float64)
            reading = np.concatenate([values, np.zeros(max(0, int(block[-1]) + 4 * scale - len(values)))])
            at, far = _seeds(reading, block, scale)
            keep = (at + scale + far <= slab.n) & ~_inside(start, end, at, at + scale + far)
            at, far = at[keep], far[keep]
            order = np.lexsort((at, far))
            at, far = at[order], far[order]
            head = np.ones(len(at), bool)  # neighbouring blocks at one distance are one stretch
            head[1:] = (far[1:] != far[:-1]) | (at[1:] != at[:-1] + scale)
            heads = np.flatnonzero(head)
            tails = np.append(heads[1:], len(at)) - 1 if len(heads) else heads
            first, size = reach.stretches(at[heads], at[tails], far[heads]) if len(heads) else (heads, heads)
            long = size >= np.maximum(least_words, least_periods * far[heads])
            found = np.unique(np.stack([first[long], size[long], far[heads][long]], 1), axis=0)
            for s, n, d in found.tolist():
                for s, n in reach.exact(s, n, d):
                    if n >= max(least_words, least_periods * d):
                        runs[s, s + n] = min(d, runs.get((s, s + n), d))
        scale *= 2
    table = np.array(sorted((s, q, e - s) for (s, e), q in runs.items()), np.int64).reshape(-1, 3)
    text = slab.text[table[:, 0]]
    return text, table[:, 0] - slab.first[text], table[:, 2], table[:, 1]


def _joined(words: Words, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(offsets by text, bytes) of the kept words of every text, joined by one space."""
    doc, start, end = words.doc[kept], words.start[kept], words.end[kept]
    spaced = np.zeros(len(kept), bool)
    spaced[:-1] = doc[1:] == doc[:-1]
    offset = np.concatenate([[0], np.cumsum(end - start + spaced)])
    out = np.empty(int(offset[-1]), np.uint8)
    lo = 0
    while lo < len(kept):  # pieces of about a megabyte
        hi = max(lo + 1, int(np.searchsorted(offset, offset[lo] + (1 << 20))) - 1)
        a, b = int(offset[lo]), int(offset[hi])
        source = np.arange(a, b) + np.repeat(start[lo:hi] - offset[lo:hi], np.diff(offset[lo : hi + 1]))
        out[a:b] = words.raw[source]
        lo = hi
    out[offset[1:][spaced] - 1] = 0x20
    return offset[np.searchsorted(doc, np.arange(words.n + 1))], out


RUNS = "array<struct<start:long,length:long,period:long>>"


def periodic_runs(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> DataFrame:
    """One row for each document: columns `keep`, n_words, runs, collapsed.

    runs: (start, length, period) of every run by start, then period; start is a
    word number from 0.  collapsed: the text without the words that stand in a
    run after its first `period` words, joined by one space.  A null or empty
    text has no word, no run and an empty collapsed text.  Equal rows stay and
    give equal results; columns other than `keep` and `text` are not read, so
    any names may stand there; an empty table gives no rows.  A text is worked
    on whole in one task, in some 200 bytes for each of its words.
    """
    fields = [T.StructField(f"k{i}", docs.schema[c].dataType) for i, c in enumerate(keep)]
    runs_type = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")]))
    schema = T.StructType([*fields, T.StructField("n_words", T.LongType()), T.StructField("runs", runs_type), T.StructField("collapsed", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(len(keep))
            for lo, hi in slabs(column):
                words = Words(column.slice(lo, hi - lo), lower=False)
                doc, start, length, period = find_runs(words.key, words.counts, least_words, least_periods)
                step = np.zeros(len(words.key) + 1, np.int64)
                np.add.at(step, words.ptr[doc] + start + period, 1)
                np.add.at(step, words.ptr[doc] + start + length, -1)
                offset, raw = _joined(words, np.flatnonzero(np.cumsum(step[:-1]) == 0))
                triples = pa.StructArray.from_arrays([pa.array(x) for x in (start, length, period)], ["start", "length", "period"])
                first = pa.array(np.searchsorted(doc, np.arange(words.n + 1)).astype(np.int32))
                texts = pa.StringArray.from_buffers(words.n, pa.py_buffer(offset.astype(np.int32)), pa.py_buffer(raw))
                arrays = [batch.column(i).slice(lo, hi - lo) for i in range(len(keep))]
                arrays += [pa.array(words.counts), pa.ListArray.from_arrays(first, triples), texts]
                yield pa.RecordBatch.from_arrays(arrays, schema.names)

    picked = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(text).cast("string").alias("text"))
    out = map_batches(picked, run, schema)
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "n_words", "runs", "collapsed")


def with_planted_runs(key: Column, text: Column) -> Column:
    """The text, or for a tenth of the keys the text with a run planted in it, as the contract has it.

    With h = crc32(key as text) and g = floor(h / 10): where h % 10 = 0, each word
    i >= a becomes word a + (i - a) % p, a = g % n, p = 1 + floor((n - a) / (3 + g % 8)).
    """
    h = F.crc32(key.cast("string"))
    g = F.floor(h / 10)

    def planted(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = F.pmod(g, n)
        p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))
        # each value is bound once, as the only item of an array
        named = F.transform(F.array(F.struct(a.alias("a"), p.alias("p"))), lambda v: F.array_join(F.transform(words, lambda w, i: F.when(i < v["a"], w).otherwise(F.get(words, (v["a"] + F.pmod(i - v["a"], v["p"])).cast("int")))), " "))
        return F.get(named, F.lit(0))

    words = F.regexp_extract_all(text, F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    changed = F.get(F.transform(F.array(words), planted), F.lit(0))
    return F.when((h % 10 == 0) & F.rlike(text, F.lit(r"[^\x20\x09-\x0D]")), changed).otherwise(text)


def op11_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract query: the runs of every document and digests of them and of the collapsed text.

    A null doc_id has no planted run.  Nulls, equal rows and empty tables: as in periodic_runs.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = periodic_runs(docs.withColumn("text", with_planted_runs(F.col("doc_id"), F.col("text"))))
    none = F.lit(None).cast("struct<start:long,length:long,period:long>")
    greater = lambda best, r: best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"])
    best = F.aggregate("runs", none, lambda best, r: F.when(greater(best, r), r).otherwise(best))
    lines = F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n")))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        best["start"].alias("start"),
        best["length"].alias("length"),
        best["period"].alias("period"),
        F.floor(1000 * best["length"] / best["period"]).alias("exponent_milli"),  # exact: far from 2^53
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


OP11_SQL = r"""
WITH crc_table AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i)) AS t),
hashed AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
             xor(list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT), lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1]), 4294967295::BIGINT), 4294967295) AS h
           FROM documents, crc_table),
placed AS (SELECT *, len(ws) AS n, (h // 10) % len(ws) AS a, 1 + (len(ws) - (h // 10) % len(ws)) // (3 + (h // 10) % 8) AS p FROM hashed),
words AS (SELECT doc_id, n, i, ws[1 + CASE WHEN h % 10 = 0 AND i >= a THEN a + (i - a) % p ELSE i END] AS w FROM placed, unnest(range(n)) AS t(i)),
grams AS (SELECT doc_id, n, i, string_agg(w, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS g FROM words QUALIFY i <= n - 8),
same AS (SELECT x.doc_id, x.i, y.i - x.i AS d FROM grams x JOIN grams y USING (doc_id, g) WHERE y.i > x.i AND 3 * (y.i - x.i) <= x.n),
stretches AS (SELECT doc_id, d, min(i) AS start, count(*) + 7 + d AS length
              FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, d ORDER BY i) AS island FROM same) GROUP BY doc_id, d, island HAVING count(*) + 7 + d >= greatest(24, 3 * d)),
runs AS (SELECT doc_id, start, length, min(d) AS period FROM stretches GROUP BY ALL),
listed AS (SELECT doc_id, count(*) AS n_runs, string_agg(concat(start, ',', length, ',', period, chr(10)), '' ORDER BY start, period) AS lines,
             arg_max(struct_pack(start := start, length := length, period := period), (length::DOUBLE / period, -start, -period)) AS best FROM runs GROUP BY doc_id),
dropped AS (SELECT DISTINCT doc_id, i FROM runs, unnest(range(start + period, start + length)) AS t(i)),
kept AS (SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS collapsed FROM words ANTI JOIN dropped USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, best.start AS start, best.length AS length, best.period AS period, 1000 * best.length // best.period AS exponent_milli,
       sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(collapsed, '')) AS collapsed_sha256
FROM hashed LEFT JOIN listed USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
