"""Quality rules run as a short-circuit cascade.

Each rule rejects a document by one metric.  On a bounded sample the operator
measures what a rule costs and how many of the documents still alive it
rejects, and orders the rules greedily by rejection per cost.  On all documents
the rules then run in that order, each on the survivors of those before it.
The verdict is a conjunction, so the order never changes it.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._store import map_batches
from ._text import Words, covered, repeated_in_doc, slabs

#: Documents of the calibration sample (expected number; whole texts).
SAMPLE_DOCS = 512
WINDOW = 8

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_ALPHA = _UPPER.copy()
_ALPHA[97:123] = True


def _n_words(w: Words) -> np.ndarray:
    return w.counts.astype(np.int64)


def _word_chars(w: Words) -> np.ndarray:
    begins = (w.raw & 0xC0) != 0x80
    total = np.concatenate([[0], np.cumsum(begins, dtype=np.int64)])
    return w.per_doc(total[w.end] - total[w.start])


def _n_symbols(w: Words) -> np.ndarray:
    return w.bytes_sum(_SYMBOL[w.raw])


def _lines(w: Words, i: int) -> list[bytes]:
    return [x for x in w.text(i).split(b"\n") if x.strip()]


def _n_lines(w: Words) -> np.ndarray:
    return np.array([len(_lines(w, i)) for i in range(w.n)], np.int64)


def _n_dup_lines(w: Words) -> np.ndarray:
    out = np.zeros(w.n, np.int64)
    for i in range(w.n):
        lines = _lines(w, i)
        out[i] = len(lines) - len(set(lines))
    return out


def _n_repeat_words(w: Words) -> np.ndarray:
    at, key = w.grams(WINDOW)
    twice = at[repeated_in_doc(w.doc[at], key)]
    return w.per_doc(covered(len(w.key), twice, WINDOW))


def _n_stutter(w: Words) -> np.ndarray:
    same = np.zeros(len(w.key), bool)
    same[1:] = (w.key[1:] == w.key[:-1]) & (w.doc[1:] == w.doc[:-1])
    return w.per_doc(same)


def _n_upper(w: Words) -> np.ndarray:
    return w.bytes_sum(_UPPER[w.raw])


def _n_alpha(w: Words) -> np.ndarray:
    return w.bytes_sum(_ALPHA[w.raw])


#: Metrics by name; each gives one integer a text.
METRICS: dict[str, Callable[[Words], np.ndarray]] = {
    "n_words": _n_words,
    "word_chars": _word_chars,
    "n_symbols": _n_symbols,
    "n_lines": _n_lines,
    "n_dup_lines": _n_dup_lines,
    "n_repeat_words": _n_repeat_words,
    "n_stutter": _n_stutter,
    "n_upper": _n_upper,
    "n_alpha": _n_alpha,
}


@dataclass(frozen=True)
class Rule:
    """Rejects a text if any bound fails: scale * metric compared with times * base.

    bounds: (metric, scale, "<" or ">", times, base metric or None for 1).
    """

    name: str
    bounds: tuple[tuple[str, int, str, int, str | None], ...]

    def rejects(self, value: Callable[[str], np.ndarray]) -> np.ndarray:
        out = None
        for metric, scale, sign, times, base in self.bounds:
            left = scale * value(metric)
            right = times * (value(base) if base else np.ones_like(left))
            hit = left < right if sign == "<" else left > right
            out = hit if out is None else out | hit
        return out


#: The rules of the base verdict.
BASE_RULES = (
    Rule("few_words", (("n_words", 1, "<", 20, None),)),
    Rule("repeated_windows", (("n_repeat_words", 100, ">", 30, "n_words"),)),
)
#: Production rules: the base and what marks junk besides.
RULES = (
    *BASE_RULES,
    Rule("symbols", (("n_symbols", 100, ">", 10, "n_words"),)),
    Rule("repeated_lines", (("n_dup_lines", 100, ">", 50, "n_lines"),)),
    Rule("word_length", (("word_chars", 1, "<", 2, "n_words"), ("word_chars", 1, ">", 12, "n_words"))),
    Rule("stutter", (("n_stutter", 100, ">", 30, "n_words"),)),
    Rule("shouting", (("n_upper", 100, ">", 50, "n_alpha"),)),
)


class _Lazy:
    """Metrics of a slab, computed once, and only for the texts that are asked about."""

    def __init__(self, column: pa.Array):
        self.column, self.n, self.full = column, len(column), {}
        self.words = Words(column, lower=False)

    def all(self, name: str) -> np.ndarray:
        if name not in self.full:
            self.full[name] = METRICS[name](self.words)
        return self.full[name]

    def some(self, rows: np.ndarray) -> Callable[[str], np.ndarray]:
        """Values for `rows`; a metric not known yet is computed on those texts alone."""
        if len(rows) == self.n:
            return self.all
        part: list[Words] = []
        known: dict[str, np.ndarray] = {}

        def value(name: str) -> np.ndarray:
            if name in self.full:
                return self.full[name][rows]
            if name not in known:
                if not part:
                    part.append(Words(self.column.take(pa.array(rows)), lower=False))
                known[name] = METRICS[name](part[0])
            return known[name]

        return value


def _cascade(column: pa.Array, rules: list[Rule], report: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
    """(reported metrics, index of the first rule that rejects or -1)."""
    lazy = _Lazy(column)
    out = [lazy.all(name) for name in report]
    verdict = np.full(lazy.n, -1, np.int32)
    alive = np.arange(lazy.n)
    for k, rule in enumerate(rules):
        if not len(alive):
            break
        hit = rule.rejects(lazy.some(alive))
        verdict[alive[hit]] = k
        alive = alive[~hit]
    return out, verdict


def calibrate(docs: DataFrame, text: str, rules: tuple[Rule, ...], sample_docs: int = SAMPLE_DOCS) -> list[Rule]:
    """Orders rules by rejection per cost, as measured on about `sample_docs` documents.

    The sample is a fixed share of the rows by a hash of the text, so it covers
    the whole table.  Executors measure; the driver gets a bit per rule and
    sampled document.  Greedy: each next rule is judged on what is still alive.
    An empty sample leaves the given order.
    """
    rows = docs.count()
    share = max(1, rows // sample_docs)
    sample = docs.select(F.col(text).cast("string").alias("text")).where(
        F.pmod(F.xxhash64(F.coalesce("text", F.lit(""))), F.lit(share)) == 0
    )

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in slabs(batch.column(0)):
                column = batch.column(0).slice(lo, hi - lo)
                masks, costs = [], []
                for rule in rules:
                    lazy = _Lazy(column)
                    began = time.thread_time_ns()
                    masks.append(np.packbits(rule.rejects(lazy.all)).tobytes())
                    costs.append(time.thread_time_ns() - began)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([hi - lo], pa.int64()), pa.array([costs], pa.list_(pa.int64())), pa.array([masks], pa.list_(pa.binary()))],
                    ["n", "costs", "masks"],
                )

    got = map_batches(sample, measure, "n long, costs array<long>, masks array<binary>").collect()
    if not got:
        return list(rules)
    cost = np.sum([r.costs for r in got], axis=0) + 1.0
    hits = [np.concatenate([np.unpackbits(np.frombuffer(r.masks[k], np.uint8))[: r.n].astype(bool) for r in got]) for k in range(len(rules))]
    alive, left, order = np.ones(len(hits[0]), bool), list(range(len(rules))), []
    while left:
        best = max(left, key=lambda k: ((hits[k] & alive).sum() / cost[k], -cost[k], -k))
        order.append(rules[best])
        alive &= ~hits[best]
        left.remove(best)
    return order


def quality_cascade(
    docs: DataFrame,
    text: str = "text",
    keep: tuple[str, ...] = ("doc_id",),
    rules: tuple[Rule, ...] = RULES,
    report: tuple[str, ...] = (),
    order: list[Rule] | None = None,
) -> DataFrame:
    """One row for each document: columns `keep`, metrics `report`, kept, rejected_by.

    A null or empty text has no word, so the metrics are 0.  Equal rows stay
    and get equal verdicts; columns other than `keep` and `text` are not read.
    rejected_by (the first rule in cascade order, null if kept) may differ
    between runs, as measured costs do; kept cannot.
    """
    order = list(order) if order is not None else calibrate(docs, text, rules)
    names = [r.name for r in order]
    fields = [T.StructField(f"k{i}", docs.schema[c].dataType) for i, c in enumerate(keep)]
    fields += [T.StructField(f"m{i}", T.LongType()) for i in range(len(report))]
    schema = T.StructType([*fields, T.StructField("kept", T.BooleanType()), T.StructField("by", T.StringType())])
    asked = list(report)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(len(keep))
            for lo, hi in slabs(column):
                values, verdict = _cascade(column.slice(lo, hi - lo), order, asked)
                by = pa.array([names[k] if k >= 0 else None for k in verdict], pa.string())
                arrays = [batch.column(i).slice(lo, hi - lo) for i in range(len(keep))]
                arrays += [pa.array(v.astype(np.int64)) for v in values] + [pa.array(verdict < 0), by]
                yield pa.RecordBatch.from_arrays(arrays, [f.name for f in schema.fields])

    picked = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(text).cast("string").alias("text"))
    out = map_batches(picked, run, schema)
    renamed = [F.col(f"k{i}").alias(c) for i, c in enumerate(keep)] + [F.col(f"m{i}").alias(m) for i, m in enumerate(report)]
    return out.select(*renamed, "kept", F.col("by").alias("rejected_by"))


def keep_good(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of `docs` that the cascade keeps, with all their columns, of any names.

    A null or empty text has no word and goes; equal rows stay or go together;
    an empty table gives no rows.
    """
    order = calibrate(docs, text, rules)
    schema = docs.schema

    at = schema.names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in slabs(batch.column(at)):
                part = batch.slice(lo, hi - lo)
                _, verdict = _cascade(part.column(at), order, [])
                if (verdict < 0).any():
                    yield part.filter(pa.array(verdict < 0))

    return map_batches(docs, run, schema)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract query: base metrics, base_failed and the cascade's verdict for every document.

    Nulls, equal rows and empty tables: as in quality_cascade.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    base = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    out = quality_cascade(docs, report=base)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return out.select("doc_id", *base, failed.alias("base_failed"), "kept")


OP5_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
win AS (SELECT doc_id, i, ws[i:i+7] AS g FROM w, unnest(range(1, greatest(len(ws) - 6, 1))) AS t(i)),
twice AS (SELECT doc_id, g FROM win GROUP BY ALL HAVING count(*) > 1),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM win JOIN twice USING (doc_id, g), unnest(range(0, 8)) AS t(k) GROUP BY doc_id),
st AS (SELECT doc_id, count(*) AS n FROM w, unnest(range(2, len(ws) + 1)) AS t(i) WHERE ws[i] = ws[i-1] GROUP BY doc_id),
m AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words,
        length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
        (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, len(ls) AS n_lines,
        coalesce(cov.n, 0)::BIGINT AS n_repeat_words, coalesce(st.n, 0) AS n_stutter,
        length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper,
        length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS n_alpha
      FROM w LEFT JOIN cov USING (doc_id) LEFT JOIN st USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR 100 * n_symbols > 10 * n_words
            OR 100 * n_dup_lines > 50 * n_lines OR word_chars < 2 * n_words OR word_chars > 12 * n_words
            OR 100 * n_stutter > 30 * n_words OR 100 * n_upper > 50 * n_alpha) AS kept
FROM m
"""
