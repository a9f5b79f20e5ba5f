"""Language identification: script ranges, per-word scores, Viterbi spans.

A model holds, for each learned language, smoothed log probabilities of hashed
four-byte grams and the scripts it is written in.  A word is scored under every
language that its script allows; a Viterbi pass over a document's words with a
constant penalty for a switch labels spans of one language each.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._store import map_batches
from ._text import NOT_LETTER, Words, slabs

#: Expected number of training documents for each language.
SAMPLE_PER_LANG = 2000
BUCKET_BITS = 17
#: Log probability that a change of language costs.
SWITCH_PENALTY = 14.0
#: A language uses a script that holds at least this share of its words.
SCRIPT_SHARE = 0.002
_SLAB = 3 << 20
_OFF = -1e4

#: First code point of a range, and the script of its letters; 0 where they have none of their own.
_RANGES = [
    (0x00, 0), (0x41, 1), (0x5B, 0), (0x61, 1), (0x7B, 0), (0xAA, 1), (0xAB, 0), (0xB5, 1), (0xB6, 0), (0xBA, 1), (0xBB, 0),
    (0xC0, 1), (0xD7, 0), (0xD8, 1), (0xF7, 0), (0xF8, 1), (0x2B0, 0), (0x370, 2), (0x400, 3), (0x530, 4),
    (0x590, 0), (0x5D0, 5), (0x5F5, 0), (0x620, 6), (0x660, 0), (0x66E, 6), (0x900, 7), (0xE00, 8), (0x10A0, 9),
    (0x1100, 10), (0x1200, 11), (0x1E00, 1), (0x1F00, 2), (0x2000, 0), (0x2C60, 1), (0x2C80, 0), (0x3040, 12),
    (0x3100, 0), (0x3400, 13), (0x4DC0, 0), (0x4E00, 13), (0xA000, 0), (0xAC00, 10), (0xD7A4, 0), (0xF900, 13), (0xFB00, 0),
    (0xFF21, 1), (0xFF3B, 0), (0xFF41, 1), (0xFF5B, 0), (0xFF66, 12), (0xFFA0, 0), (0x20000, 13), (0x32000, 0),
]
#: The script of letters outside these ranges; the least, so that it is a word's only where no other letter is in it.
_OTHER = 1
#: No letters are assigned from here on.
_LAST = 0x34000


def _all_ranges() -> tuple[np.ndarray, np.ndarray]:
    """First code point and script of every range; what Unicode calls no letter has script 0, and letters of no listed range share one."""
    code = np.arange(_LAST + 1)
    listed = np.array([b for _, b in _RANGES])[np.searchsorted([a for a, _ in _RANGES], code, "right") - 1]
    letter = np.array([unicodedata.category(chr(c))[0] == "L" for c in code.tolist()])
    script = np.where(letter, np.where(listed > 0, listed + _OTHER, _OTHER), 0)
    first = np.flatnonzero(np.diff(script, prepend=-1))
    return first, script[first].astype(np.uint8)


_FIRST, _SCRIPT = _all_ranges()
N_SCRIPTS = int(_SCRIPT.max()) + 1

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def _byte_scripts(raw: np.ndarray) -> np.ndarray:
    """Script of the character that begins at each byte, 0 inside characters."""
    out = np.zeros(len(raw), np.uint8)
    out[~NOT_LETTER[raw] & (raw < 128)] = 1 + _OTHER  # Latin
    at = np.flatnonzero(raw >= 0xC0)
    if len(at):
        b = [raw[np.minimum(at + k, len(raw) - 1)].astype(np.int64) for k in range(4)]
        two = (b[0] & 0x1F) << 6 | b[1] & 0x3F
        three = (b[0] & 0x0F) << 12 | (b[1] & 0x3F) << 6 | b[2] & 0x3F
        four = (b[0] & 0x07) << 18 | (b[1] & 0x3F) << 12 | (b[2] & 0x3F) << 6 | b[3] & 0x3F
        code = np.where(b[0] < 0xE0, two, np.where(b[0] < 0xF0, three, four))
        out[at] = _SCRIPT[np.searchsorted(_FIRST, code, "right") - 1]
    return out


class Letters:
    """The letter runs of a slab: script, grams and number of letters of each word."""

    def __init__(self, column: pa.Array):
        w = Words(column, sep=NOT_LETTER)
        script, letters = np.zeros(0, np.uint8), np.zeros(0, np.int64)
        if len(w.start):
            each = _byte_scripts(w.raw)
            script = np.maximum.reduceat(each, w.start)
            letters = np.add.reduceat((each > 0).astype(np.int64), w.start)  # between words there is none
        keep = script > 0
        self.letters = letters[keep]
        self.start, self.end, self.doc, self.script = w.start[keep], w.end[keep], w.doc[keep], script[keep]
        self.n = w.n
        self.counts = np.bincount(self.doc, minlength=w.n)
        self.ptr = np.concatenate([[0], np.cumsum(self.counts)])
        self.length = self.end - self.start
        self.raw = w.raw

    def grams(self) -> tuple[np.ndarray, np.ndarray]:
        """(bucket of every gram, first gram of every word): a word of n bytes, blank before and after, has n grams."""
        slot = self.length + 3
        first = np.concatenate([[0], np.cumsum(slot)])
        padded = np.full(int(first[-1]) + 3, 32, np.uint8)
        total = int(self.length.sum())
        begin = np.concatenate([[0], np.cumsum(self.length)])[:-1]
        within = np.arange(total, dtype=np.int64) - np.repeat(begin, self.length)
        place = within + np.repeat(first[:-1], self.length)
        padded[place + 1] = _FOLD[self.raw[within + np.repeat(self.start, self.length)]]
        wide = padded.astype(np.uint32)
        four = wide[:-3] << 24 | wide[1:-2] << 16 | wide[2:-1] << 8 | wide[3:]
        return (four[place] * np.uint32(2654435761)) >> np.uint32(32 - BUCKET_BITS), begin


@dataclass(frozen=True)
class LanguageModel:
    """langs: sorted codes; table: log probability of a gram (bucket x language); allowed: script x language."""

    langs: list[str]
    table: np.ndarray
    allowed: np.ndarray

    def emissions(self, t: Letters) -> np.ndarray:
        bucket, first = t.grams()
        if not len(first):
            return np.zeros((0, len(self.langs)))
        score = np.add.reduceat(self.table[bucket], first, axis=0).astype(np.float64)
        ok = self.allowed[t.script]
        ok[~ok.any(axis=1)] = True
        return np.where(ok, score, _OFF)


def viterbi(emission: np.ndarray, counts: np.ndarray, ptr: np.ndarray, penalty: float) -> np.ndarray:
    """Best state of every word; all documents advance together, longest first."""
    total, states = emission.shape
    label = np.zeros(total, np.int16)
    docs = np.argsort(-counts, kind="stable")
    size = counts[docs]
    docs, size = docs[size > 0], size[size > 0]
    if not total:
        return label
    begin = ptr[docs]
    active = np.searchsorted(-size, -np.arange(int(size[0])), "left")
    came = np.zeros(total, np.int16)
    stays = np.zeros((total, states), bool)
    score = emission[begin].copy()
    for t in range(1, int(size[0])):
        m = active[t]
        now, at = score[:m], begin[:m] + t
        best = now.argmax(axis=1)
        jump = now[np.arange(m), best] - penalty
        stay = now >= jump[:, None]
        stays[at], came[at] = stay, best
        score[:m] = np.where(stay, now, jump[:, None]) + emission[at]
    state = score.argmax(axis=1)
    for t in range(int(size[0]) - 1, -1, -1):
        m = active[t] if t else len(docs)
        at = begin[:m] + t
        label[at] = state[:m]
        if t:
            state[:m] = np.where(stays[at, state[:m]], state[:m], came[at])
    return label


def train(docs: DataFrame, text: str, lang: str, sample_per_lang: int = SAMPLE_PER_LANG) -> LanguageModel:
    """Learns from rows with a text and a language.

    About `sample_per_lang` different texts of each language are used, chosen
    by a hash; copies count once.  Executors count; the driver gets one table a
    language and task of at most four tasks.
    """
    rows = docs.select(F.col(lang).alias("lang"), F.col(text).cast("string").alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")
    rows = rows.withColumn("h", F.xxhash64("text"))
    sizes = {r.lang: r.n for r in rows.select("lang", "h").distinct().groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(sizes)
    if not langs:
        return LanguageModel([], np.zeros((1 << BUCKET_BITS, 0), np.float32), np.zeros((N_SCRIPTS, 0), bool))
    share = F.create_map(*[F.lit(x) for k in langs for x in (k, min(1.0, sample_per_lang / sizes[k]))])
    chosen = rows.where(F.pmod("h", F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20))
    sample = chosen.dropDuplicates(["lang", "h"]).select("lang", "text").repartition(4)
    index = {k: i for i, k in enumerate(langs)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = np.zeros((len(langs), 1 << BUCKET_BITS), np.int64)
        scripts = np.zeros((len(langs), N_SCRIPTS), np.int64)
        for batch in batches:
            code = np.array([index[k] for k in batch.column(0).to_pylist()])
            for lo, hi in slabs(batch.column(1), _SLAB):
                t = Letters(batch.column(1).slice(lo, hi - lo))
                of = code[lo:hi][t.doc]
                bucket, _ = t.grams()
                for k in np.unique(code[lo:hi]):
                    grams[k] += np.bincount(bucket[np.repeat(of == k, t.length)], minlength=1 << BUCKET_BITS)
                    scripts[k] += np.bincount(t.script[of == k], minlength=N_SCRIPTS)
        for k in range(len(langs)):
            if scripts[k].any():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k], pa.int32()), pa.array([grams[k].astype(np.int32).tobytes()]), pa.array([scripts[k].tobytes()])],
                    ["k", "grams", "scripts"],
                )

    grams = np.zeros((len(langs), 1 << BUCKET_BITS))
    scripts = np.zeros((len(langs), N_SCRIPTS))
    for r in map_batches(sample, count, "k int, grams binary, scripts binary").collect():
        grams[r.k] += np.frombuffer(r.grams, np.int32)
        scripts[r.k] += np.frombuffer(r.scripts, np.int64)
    smooth = 0.05
    table = np.log((grams + smooth) / (grams.sum(axis=1, keepdims=True) + smooth * grams.shape[1]))
    allowed = scripts >= np.maximum(1, SCRIPT_SHARE * scripts.sum(axis=1, keepdims=True))
    return LanguageModel(langs, np.ascontiguousarray(table.T, np.float32), np.ascontiguousarray(allowed.T))


def _spans(label: np.ndarray, t: Letters, i: int, langs: list[str]) -> list[dict]:
    """Runs of one language in text i: byte ranges without the blanks around them."""
    lo, hi = t.ptr[i], t.ptr[i + 1]
    if lo == hi:
        return []
    cut = np.concatenate([[lo], np.flatnonzero(label[lo + 1 : hi] != label[lo : hi - 1]) + lo + 1, [hi]])
    base = t.doc_start[i]
    return [{"lang": langs[label[a]], "first_byte": int(t.start[a] - base), "end_byte": int(t.end[b - 1] - base)} for a, b in zip(cut[:-1], cut[1:])]


SPAN = T.ArrayType(
    T.StructType([T.StructField("lang", T.StringType()), T.StructField("first_byte", T.LongType()), T.StructField("end_byte", T.LongType())])
)


def identify(
    docs: DataFrame,
    model: LanguageModel,
    text: str = "text",
    keep: tuple[str | Column, ...] = ("doc_id",),
    penalty: float = SWITCH_PENALTY,
    spans: bool = True,
) -> DataFrame:
    """One row for each document: columns `keep`, lang_pred, score, and the labelled spans if asked.

    lang_pred is the language that most letters are labelled with (ties: the
    first code), score the share of the letters so labelled.  A text that is
    null or without a letter is `und` with score 0 and no spans; so is every
    text if nothing was learned.  Equal rows get equal results.
    """
    named = [c if isinstance(c, Column) else F.col(c) for c in keep]
    picked = docs.select(*named, F.col(text).cast("string").alias("__text"))
    kept = picked.schema.fields[:-1]
    schema = T.StructType(
        [
            *[T.StructField(f"k{i}", f.dataType) for i, f in enumerate(kept)],
            T.StructField("lang_pred", T.StringType()),
            T.StructField("score", T.DoubleType()),
            *([T.StructField("spans", SPAN)] if spans else []),
        ]
    )
    names = [f.name for f in schema.fields]
    langs = model.langs
    # the table has 2^BUCKET_BITS rows of four bytes a learned language
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            column = batch.column(len(kept))
            for lo, hi in slabs(column, _SLAB):
                part = column.slice(lo, hi - lo)
                t = Letters(part)
                t.doc_start = np.zeros(t.n, np.int64)
                if spans:
                    from ._text import string_buffers

                    t.doc_start = string_buffers(part)[0]
                pred: list[str] = ["und"] * t.n
                score = np.zeros(t.n)
                label = np.zeros(0, np.int16)
                if langs and len(t.start):
                    label = viterbi(known.emissions(t), t.counts, t.ptr, penalty)
                    weight = np.bincount(t.doc * len(langs) + label, weights=t.letters, minlength=t.n * len(langs)).reshape(t.n, -1)
                    some = weight.sum(axis=1)
                    best = weight.argmax(axis=1)
                    pred = [langs[b] if s else "und" for b, s in zip(best, some)]
                    score = weight.max(axis=1) / np.maximum(some, 1)
                arrays = [batch.column(i).slice(lo, hi - lo) for i in range(len(kept))]
                arrays += [pa.array(pred, pa.string()), pa.array(score)]
                if spans:
                    rows = [_spans(label, t, i, langs) if len(label) else [] for i in range(t.n)]
                    kind = pa.list_(pa.struct([("lang", pa.string()), ("first_byte", pa.int64()), ("end_byte", pa.int64())]))
                    arrays.append(pa.array(rows, kind))
                yield pa.RecordBatch.from_arrays(arrays, names)

    out = map_batches(picked, run, schema)
    return out.select(*[F.col(f"k{i}").alias(f.name) for i, f in enumerate(kept)], *names[len(kept) :])


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract query: learned where crc32(doc_id) mod 5 is not 0, predicted for every document; spans as JSON.

    A row without doc_id has no remainder: it is not learned from and not held out.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    part = F.crc32(F.col("doc_id").cast("string")) % 5
    model = train(docs.where(part != 0), "text", "lang")
    held = F.coalesce(part == 0, F.lit(False)).alias("held_out")
    return identify(docs, model, keep=("doc_id", held)).withColumn("spans", F.to_json("spans"))
