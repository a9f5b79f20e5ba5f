"""Substring deduplication by sliding sentence spans.

Texts are split into sentences; a span is a run of at least three sentences and
sixteen words, one from every sentence on.  Spans are hashed and joined
globally; a sentence goes if a span that covers it also occurs earlier: in an
earlier place of the same text, or in a document with a smaller id.

Sentences end at . ! ? or a line's end.  One of more than twelve words is cut
further, after each word whose hash is the least of some nine words in a row.
So nine words always hold a cut, and a passage without full stops, or one that
begins inside another sentence, has the same sentences wherever it stands; one
of 51 words has at least three whole ones.  Words are runs between ASCII white
space: text written without blanks is deduplicated by its lines alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._store import map_batches, materialize, numbered
from ._text import Words, mix, signed, slabs

MIN_SENTENCES = 3
MIN_WORDS = 16
LONG_SENTENCE = 12
#: In a long sentence so many words in a row hold a cut.
CUT_WINDOW = 9

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
#: What may close a sentence after its stop, and stops of more than one byte.
_CLOSERS = np.frombuffer(b"\"')]}", np.uint8)
_STOPS = np.frombuffer(b".!?", np.uint8)
_WIDE_STOPS = [b"\xe3\x80\x82", b"\xef\xbc\x81", b"\xef\xbc\x9f", b"\xe2\x80\xa6"]


def _geometric(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base), np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _stops(w: Words) -> np.ndarray:
    """Whether each word ends a sentence by its last character, a closing quote or bracket aside."""
    last = w.end - 1
    closed = np.isin(w.raw[last], _CLOSERS) & (last > w.start)
    last = last - closed
    out = np.isin(w.raw[last], _STOPS)
    wide = np.flatnonzero((w.raw[last] >= 0x80) & (last - 2 >= w.start))
    for mark in _WIDE_STOPS:
        a, b, c = mark
        out[wide] |= (w.raw[last[wide] - 2] == a) & (w.raw[last[wide] - 1] == b) & (w.raw[last[wide]] == c)
    return out


def _least_of_windows(key: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Whether each word has the least key of CUT_WINDOW words in a row of one long sentence; of equal ones the last."""
    out = np.zeros(len(key), bool)
    number = np.concatenate([[0], np.cumsum(ends)[:-1]])
    first = np.flatnonzero(np.bincount(number)[number] > LONG_SENTENCE)
    first = first[first + CUT_WINDOW <= len(key)]
    first = first[number[first] == number[first + CUT_WINDOW - 1]]
    if len(first):
        least, at = key[first], first.copy()
        for k in range(1, CUT_WINDOW):
            other = key[first + k]
            lower = other <= least
            least, at = np.where(lower, other, least), np.where(lower, first + k, at)
        out[at] = True
    return out


class Sentences:
    """Sentences and spans of a slab.

    first: first word of every sentence, and the number of words; doc: text of
    each; ptr: first sentence of each text; begin: first byte of each sentence,
    counted from the text's start (white space belongs to what stands before).
    """

    def __init__(self, column: pa.Array):
        w = Words(column)
        n = len(w.key)
        ends = np.zeros(n, bool)
        if n:
            ends = _stops(w)
            lines = np.concatenate([[0], np.cumsum(w.raw == 10)])
            ends[:-1] |= lines[w.start[1:]] > lines[w.end[:-1]]
            ends[:-1] |= w.doc[1:] != w.doc[:-1]
            ends[-1] = True
            ends |= _least_of_windows(w.key, ends)
        self.words = w
        self.first = np.concatenate([[0], np.flatnonzero(ends) + 1])
        self.doc = w.doc[self.first[:-1]]
        self.ptr = np.searchsorted(self.doc, np.arange(w.n + 1))
        self.begin = w.start[self.first[:-1]] - w.doc_off[self.doc]
        self.begin[self.ptr[:-1][np.diff(self.ptr) > 0]] = 0

    def spans(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first sentence, sentence after the last, key) of every span."""
        at = np.arange(len(self.doc))
        end = np.maximum(at + MIN_SENTENCES, np.searchsorted(self.first, self.first[:-1] + MIN_WORDS))
        fits = end <= self.ptr[self.doc + 1]
        at, end = at[fits], end[fits]
        n = len(self.words.key)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.words.key * _geometric(_BASE, n), dtype=np.uint64)])
        a, b = self.first[at], self.first[end]
        key = (total[b] - total[a]) * _geometric(_INVERSE, n + 1)[a]
        return at, end, mix(key ^ (b - a).astype(np.uint64))


def _earlier_in_doc(doc: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Whether the same key stands earlier in the same text; items are in order."""
    order = np.lexsort((np.arange(len(key)), key, doc))
    out = np.zeros(len(key), bool)
    d, k = doc[order], key[order]
    out[order[1:]] = (d[1:] == d[:-1]) & (k[1:] == k[:-1])
    return out


def span_keys(docs: DataFrame, text: str, key: str) -> DataFrame:
    """(id, span): each distinct span of every document once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in slabs(batch.column(1)):
                s = Sentences(batch.column(1).slice(lo, hi - lo))
                at, _, span = s.spans()
                new = ~_earlier_in_doc(s.doc[at], span)
                ids = batch.column(0).slice(lo, hi - lo).take(pa.array(s.doc[at[new]]))
                yield pa.RecordBatch.from_arrays([ids, pa.array(signed(span[new]))], ["id", "span"])

    return map_batches(docs.select(key, text), run, "id long, span long")


def repeated_spans(docs: DataFrame, text: str, key: str) -> DataFrame:
    """(id, spans): of every document the spans that also occur in one with a smaller id."""
    spans = span_keys(docs, text, key)
    known = spans.groupBy("span").agg(F.count("*").alias("n"), F.min("id").alias("first")).where("n > 1").select("span", "first")
    known = materialize(known, "spans")  # written, so that Spark can split the documents of a frequent span in the join
    later = spans.join(known, "span").where(F.col("id") > F.col("first"))
    return later.groupBy("id").agg(F.collect_list("span").alias("spans"))  # no more than the document has sentences


def dedup_substrings(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows and columns of `docs` with the text shortened, and n_sentences and n_removed.

    Documents are ordered by their key, of any type that can be sorted, null
    last; rows of one key by a hash of the text, equal rows in any order.  So
    of a passage in rows of one key, or in equal rows, one stays as well.  A
    null text stays null; texts without a repeat stay as they are, byte for
    byte.  A document may lose all its text.  An empty table stays empty, and
    other columns may have any name.
    """
    names = docs.columns
    body = f"c{names.index(text)}"
    inner = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(names)]).withColumn(body, F.col(body).cast("string"))
    inner = numbered(inner, f"c{names.index(key)}", body, "id")
    joined = inner.join(repeated_spans(inner, body, "id"), "id", "left").drop("id")
    out_type = T.StructType([*[f for f in joined.schema.fields if f.name != "spans"], T.StructField("n", T.LongType()), T.StructField("gone", T.LongType())])
    at_text, at_spans = joined.columns.index(body), joined.columns.index("spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in slabs(batch.column(at_text)):
                part = batch.slice(lo, hi - lo)
                column = part.column(at_text)
                s = Sentences(column)
                at, end, span = s.spans()
                doc = s.doc[at]
                hit = _earlier_in_doc(doc, span)
                lists = part.column(at_spans)
                size = lists.value_lengths().fill_null(0).to_numpy()
                known = lists.flatten().to_numpy().view(np.uint64)
                hit |= np.isin(_of_doc(doc, span), _of_doc(np.repeat(np.arange(len(size)), size), known))
                step = np.zeros(len(s.doc) + 1, np.int64)
                np.add.at(step, at[hit], 1)
                np.add.at(step, end[hit], -1)
                gone = np.cumsum(step[:-1]) > 0
                texts = column.to_pylist() if gone.any() else None
                lost = np.bincount(s.doc[gone], minlength=s.words.n)
                for i in np.flatnonzero(lost):
                    texts[i] = _without(s, i, gone)
                columns = [part.column(k) for k in range(part.num_columns) if k != at_spans]
                if texts is not None:
                    columns[at_text if at_text < at_spans else at_text - 1] = pa.array(texts, column.type)
                columns += [pa.array(np.diff(s.ptr)), pa.array(lost)]
                yield pa.RecordBatch.from_arrays(columns, out_type.names)

    clean = map_batches(joined, run, out_type)
    return clean.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], F.col("n").alias("n_sentences"), F.col("gone").alias("n_removed"))


def _of_doc(doc: np.ndarray, key: np.ndarray) -> np.ndarray:
    return mix(key ^ (doc.astype(np.uint64) * np.uint64(_BASE)))


def _without(s: Sentences, i: int, gone: np.ndarray) -> str:
    """Text i without its sentences marked in gone."""
    whole = s.words.text(i)
    lo, hi = s.ptr[i], s.ptr[i + 1]
    cuts = np.append(s.begin[lo:hi], len(whole)).tolist()
    return b"".join(whole[a:b] for a, b, out in zip(cuts, cuts[1:], gone[lo:hi].tolist()) if not out).decode()


def op1_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without their repeated passages: doc_id, text, n_sentences, n_removed.

    Nulls, ties, equal rows and empty tables: as in dedup_substrings.
    """
    return dedup_substrings(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
