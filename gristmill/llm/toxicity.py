"""Toxicity by a factorization machine over hashed terms.

Terms are lower-cased words and word beginnings, hashed to a fixed number of
buckets.  A screening pass keeps the buckets most associated with the label;
the machine learns a weight for each and a factor vector for each, so that the
score of a text also depends on which terms occur together.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._store import map_batches
from ._text import NOT_LETTER, Words, slabs

BUCKET_BITS = 20
PREFIXES = (4, 5, 6, 7)
#: Expected number of training documents of either label, and of terms kept by the screening.
SAMPLE_PER_LABEL = 3000
SCREENED = 2048
FACTORS = 8
EPOCHS = 60
BATCH = 256
SEED = 13


def _terms(column: pa.Array) -> tuple[np.ndarray, np.ndarray, int]:
    """(text, bucket) of every term occurrence, and the number of texts."""
    w = Words(column, sep=NOT_LETTER)
    docs, keys = [w.doc], [w.key]
    for size in PREFIXES:
        at, key = w.prefix_keys(size)
        docs.append(w.doc[at])
        keys.append(key)
    bucket = np.concatenate(keys) >> np.uint64(64 - BUCKET_BITS)
    return np.concatenate(docs), bucket.astype(np.int64), w.n


@dataclass(frozen=True)
class FactorMachine:
    """column: place of each bucket among the screened terms or -1; bias, weight, factor: the learned parameters."""

    column: np.ndarray
    bias: float
    weight: np.ndarray
    factor: np.ndarray

    def score(self, texts: pa.Array) -> np.ndarray:
        """Probability of label 1 for each text."""
        doc, bucket, n = _terms(texts)
        place = self.column[bucket]
        size = len(self.weight)
        pair = np.unique(doc[place >= 0] * max(size, 1) + place[place >= 0])
        doc, place = pair // max(size, 1), pair % max(size, 1)
        raw = self.bias + np.bincount(doc, weights=self.weight[place], minlength=n)
        for f in range(self.factor.shape[1]):
            v = self.factor[place, f]
            total = np.bincount(doc, weights=v, minlength=n)
            raw = raw + 0.5 * (total**2 - np.bincount(doc, weights=v * v, minlength=n))
        return 1 / (1 + np.exp(-np.clip(raw, -30, 30)))


def fit(rows: list[np.ndarray], label: np.ndarray, case_weight: np.ndarray) -> FactorMachine:
    """Screens terms by their chi-square with the label and learns the machine by AdaGrad.

    Without both labels the machine is a constant: the share of label 1, or 0
    where there are no rows at all.
    """
    column = np.full(1 << BUCKET_BITS, -1, np.int32)
    n1, n0 = int((label == 1).sum()), int((label == 0).sum())
    if not n1 or not n0:
        bias = 30.0 if n1 else -30.0
        return FactorMachine(column, bias, np.zeros(0), np.zeros((0, FACTORS)))
    in1 = np.bincount(np.concatenate([r for r, y in zip(rows, label) if y == 1]), minlength=1 << BUCKET_BITS).astype(float)
    in0 = np.bincount(np.concatenate([r for r, y in zip(rows, label) if y == 0]), minlength=1 << BUCKET_BITS).astype(float)
    seen = in1 + in0
    gap = in1 * (n0 - in0) - in0 * (n1 - in1)
    chi = np.where(seen > 1, gap**2 / np.maximum(seen * (n1 + n0 - seen), 1.0), 0.0)
    top = np.argsort(-chi, kind="stable")[:SCREENED]
    top = np.sort(top[chi[top] > 0])
    column[top] = np.arange(len(top), dtype=np.int32)
    x = np.zeros((len(rows), len(top)), np.uint8)
    for i, r in enumerate(rows):
        place = column[r]
        x[i, place[place >= 0]] = 1
    rng = np.random.default_rng(SEED)
    prior = float((case_weight * label).sum() / case_weight.sum())
    bias, w = float(np.log(prior / (1 - prior))), np.zeros(len(top), np.float32)
    v = rng.normal(0, 0.02, (len(top), FACTORS)).astype(np.float32)
    gw, gv, gb = np.full_like(w, 1e-6), np.full_like(v, 1e-6), 1e-6
    case_weight = case_weight / case_weight.mean()
    for _ in range(EPOCHS):
        for at in np.array_split(rng.permutation(len(rows)), max(1, len(rows) // BATCH)):
            b = x[at].astype(np.float32)
            total = b @ v
            raw = bias + b @ w + 0.5 * (total**2 - b @ (v * v)).sum(axis=1)
            slope = ((1 / (1 + np.exp(-np.clip(raw, -30, 30))) - label[at]) * case_weight[at] / len(at)).astype(np.float32)
            back = b.T @ slope
            dw = back + 1e-5 * w
            dv = b.T @ (slope[:, None] * total) - back[:, None] * v + 1e-4 * v
            db = float(slope.sum())
            gw += dw * dw
            gv += dv * dv
            gb += db * db
            w -= 0.15 * dw / np.sqrt(gw)
            v -= 0.03 * dv / np.sqrt(gv)
            bias -= 0.1 * db / np.sqrt(gb)
    return FactorMachine(column, bias, w.astype(np.float64), v.astype(np.float64))


def train(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "toxic", key: str = "doc_id", sample: int = SAMPLE_PER_LABEL) -> FactorMachine:
    """Learns from the labelled documents: about `sample` of either label, chosen by a hash of the key.

    Repeated labels of one document count once, as the largest.  Rows without
    key, label or document are not used.  What is sent: at most the sampled keys
    to the executors, and the sampled documents' distinct buckets to the driver.
    """
    marks = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.max(label).cast("int").alias("y"))
    sizes = {r.y: r.n for r in marks.groupBy("y").agg(F.count("*").alias("n")).collect() if r.y in (0, 1)}
    rate = {y: min(1.0, sample / n) for y, n in sizes.items()}
    if not rate:
        return fit([], np.zeros(0), np.zeros(0))
    share = F.create_map(*[F.lit(x) for y, r in rate.items() for x in (y, r)])
    chosen = marks.where(F.col("y").isin(*rate)).where(F.pmod(F.xxhash64("key"), F.lit(1 << 20)) < share[F.col("y")] * (1 << 20))
    # about 2 * sample rows of a key and a bit
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).join(F.broadcast(chosen), "key")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(0)
            for lo, hi in slabs(column):
                doc, bucket, n = _terms(column.slice(lo, hi - lo))
                pair = np.unique(doc << BUCKET_BITS | bucket)
                cut = np.searchsorted(pair >> BUCKET_BITS, np.arange(n + 1))
                low = (pair & ((1 << BUCKET_BITS) - 1)).astype(np.int32)
                found = [low[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found, pa.binary()), batch.column(1).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo)], ["terms", "y", "key"]
                )

    kind = T.StructType([T.StructField("terms", T.BinaryType()), T.StructField("y", T.IntegerType()), T.StructField("key", rows.schema["key"].dataType)])
    got = map_batches(rows.select("text", "y", "key"), extract, kind).toArrow().sort_by("key")
    y = got.column("y").to_numpy()
    terms = [np.frombuffer(b.as_py(), np.int32) for b in got.column("terms")]
    weight = np.array([1 / rate[k] for k in y])
    return fit(terms, y, weight)


def score(docs: DataFrame, model: FactorMachine, text: str = "text", keep: tuple[str | Column, ...] = ("doc_id",)) -> DataFrame:
    """One row for each document: columns `keep`, score, predicted (score >= 0.5).

    A null or empty text has no term and gets the machine's score of no term.
    """
    named = [c if isinstance(c, Column) else F.col(c) for c in keep]
    picked = docs.select(*named, F.col(text).cast("string").alias("__text"))
    kept = picked.schema.fields[:-1]
    schema = T.StructType([*[T.StructField(f"k{i}", f.dataType) for i, f in enumerate(kept)], T.StructField("score", T.DoubleType())])
    names = [f.name for f in schema.fields]
    # four bytes a bucket and 8 * (1 + FACTORS) a screened term, at every size of input
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(len(kept))
            for lo, hi in slabs(column):
                arrays = [batch.column(i).slice(lo, hi - lo) for i in range(len(kept))]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(shared.value.score(column.slice(lo, hi - lo)))], names)

    out = map_batches(picked, run, schema)
    return out.select(*[F.col(f"k{i}").alias(f.name) for i, f in enumerate(kept)], "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract query: learned where crc32(doc_id) mod 5 is not 0, scored for every document.

    A row without doc_id has no remainder: it is not learned from and not held out.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    part = F.crc32(F.col("doc_id").cast("string")) % 5
    model = train(docs, labels.where(part != 0))
    held = F.coalesce(part == 0, F.lit(False)).alias("held_out")
    return score(docs, model, keep=("doc_id", held))
