"""Document fingerprints by context-triggered piecewise hashing.

A rolling hash of the last seven bytes triggers the end of a piece; each piece
becomes one symbol of a signature.  The block size is the smallest power of two
that makes 64 pieces of it reach the text's length, and a second signature uses
twice that block size, so texts whose block sizes are equal or neighbours can
be compared by the edit distance of two signatures.
"""

from __future__ import annotations

import hashlib
import string
from bisect import bisect_left
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._store import map_batches, numbered
from ._text import arrow_type

REACH = 7
PIECES = 64
_LETTERS = string.ascii_uppercase + string.ascii_lowercase + string.digits + "+/"
_SYMBOLS = [a + b for a in _LETTERS for b in _LETTERS]

_rng = np.random.default_rng(7)
_BYTE = _rng.integers(1, 1 << 32, 256, dtype=np.uint32) | np.uint32(1)
_FACTOR = [np.uint32(pow(0x9E3779B1, k, 1 << 32)) for k in range(REACH)]


def _rolling(data: np.ndarray) -> np.ndarray:
    """A hash of the window of REACH bytes that ends at each byte."""
    t = _BYTE[data]
    r = t.copy()
    for k in range(1, min(REACH, len(t))):
        r[k:] += t[:-k] * _FACTOR[k]
    r ^= r >> np.uint32(15)
    r *= np.uint32(0x85EBCA6B)
    return r ^ (r >> np.uint32(13))


def _signature(text: bytes, ends: list[int], block: int) -> str:
    """A symbol a piece.  Pieces end where triggered, but keep between a quarter of the block size and four times it."""
    least, most, size = max(1, block // 4), 4 * block, len(text)
    out, at, k = [], 0, 0
    while at < size:
        k = bisect_left(ends, at + least - 1, k)
        cut = min(ends[k] + 1 if k < len(ends) else size, at + most, size)
        out.append(_SYMBOLS[crc32(text[at:cut]) & 4095])
        at = cut
    return "".join(out)


def fingerprint(text: bytes) -> str:
    """`level:signature:coarser signature`; two characters a piece, block size 2^level."""
    if not text:
        return "0::"
    level = max(0, ((len(text) - 1) // PIECES).bit_length())
    r = _rolling(np.frombuffer(text, np.uint8))
    ends = np.flatnonzero((r & np.uint32((1 << level) - 1)) == 0)
    coarse = ends[(r[ends] & np.uint32((2 << level) - 1)) == 0]
    return f"{level}:{_signature(text, ends.tolist(), 1 << level)}:{_signature(text, coarse.tolist(), 2 << level)}"


def edit_distance(a: list[str], b: list[str]) -> int:
    """Insertions, deletions and substitutions, by bit-parallel columns."""
    lo = 0
    while lo < len(a) and lo < len(b) and a[lo] == b[lo]:
        lo += 1
    a, b = a[lo:], b[lo:]
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    if not a or not b:
        return len(a) + len(b)
    where: dict[str, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    top = 1 << (len(a) - 1)
    plus, minus, score = full, 0, len(a)
    for y in b:
        same = where.get(y, 0)
        diagonal = same | minus
        across = (((same & plus) + plus) ^ plus) | same
        up = minus | ~(across | plus) & full
        down = plus & across
        score += bool(up & top) - bool(down & top)
        up = (up << 1 | 1) & full
        plus = (down << 1 & full) | ~(diagonal | up) & full
        minus = up & diagonal
    return score


def likeness(f: str, g: str) -> float:
    """1 for equal fingerprints, 0 for block sizes that cannot be compared, else 1 - edit distance / longer signature."""
    if f == g:
        return 1.0
    lf, f1, f2 = f.split(":")
    lg, g1, g2 = g.split(":")
    gap = int(lf) - int(lg)
    if gap == 0:
        a, b = f1, g1
    elif gap == 1:
        a, b = f1, g2
    elif gap == -1:
        a, b = f2, g1
    else:
        return 0.0
    longer = max(len(a), len(b)) // 2
    if not longer:
        return 0.0
    pieces = [[s[i : i + 2] for i in range(0, len(s), 2)] for s in (a, b)]
    return 1.0 - edit_distance(*pieces) / longer


def fingerprint_documents(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row for each document: doc_id, fingerprint; null text reads as empty, equal texts get equal fingerprints."""
    schema = T.StructType([T.StructField("doc_id", docs.schema[key].dataType), T.StructField("fingerprint", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint((s.as_py() or "").encode()) for s in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], schema.names)

    return map_batches(docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string")), run, schema)


def _bounds_above(x: Column, bounds: list[float]) -> Column:
    """How many of the falling bounds are above x, in two steps of about the square root of their number."""
    if not bounds:
        return F.lit(0)
    step = max(1, round(len(bounds) ** 0.5))
    groups = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    whole = F.size(F.filter(F.array(*[F.lit(g[-1]) for g in groups]), lambda b: x < b))
    inner = F.get(F.array(*[F.array(*map(F.lit, g)) for g in groups]), whole)
    last = F.when(whole == len(groups), F.lit(len(bounds)))
    return last.otherwise(whole * step + F.size(F.filter(inner, lambda b: x < b)))


def _dealt_in_order(docs: DataFrame, text: str, key: str) -> DataFrame:
    """Rows in ranges of descending key: range, tail, down, doc_id, text.

    Every range ends with a copy (tail 1) of the first row of the next range,
    the last range with the first row of all.  Rows are cut at quantiles of
    their numbers, so the text moves once and no task gets more than a few
    ranges.  The driver gets a row a range.
    """
    spark = docs.sparkSession
    ranges = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    rows = numbered(rows, "doc_id", "text", "number", nulls_first=True)
    place = F.col("number").cast("double")
    bounds = rows.select(place.alias("x")).approxQuantile("x", [i / ranges for i in range(1, ranges)], 0.1 / ranges) if ranges > 1 else []
    above = sorted(set(bounds), reverse=True)
    ranked = rows.select(_bounds_above(place, above).cast("int").alias("range"), F.bitwise_not("number").alias("down"), "doc_id", "text")
    firsts = sorted(ranked.groupBy("range").agg(F.min("down").alias("first")).collect())
    if not firsts:
        return ranked.select("range", F.lit(0).alias("tail"), "down", "doc_id", "text")
    numbers = [r.range for r in firsts]
    before = dict(zip(numbers, [numbers[-1], *numbers[:-1]]))
    heads = F.broadcast(spark.createDataFrame([(r.range, r.first, before[r.range]) for r in firsts], "range int, first long, before int"))  # a row a range
    places = F.array(F.struct(F.col("range").alias("to"), F.lit(0).alias("tail")))
    places = F.when(F.col("down") == F.col("first"), F.array_append(places, F.struct(F.col("before").alias("to"), F.lit(1).alias("tail")))).otherwise(places)
    spread = ranked.join(heads, "range").withColumn("at", F.explode(places))
    moved = spread.select(F.col("at.to").alias("range"), F.col("at.tail").alias("tail"), "down", "doc_id", "text")
    return moved.repartitionById(numbers[-1] + 1, F.col("range")).sortWithinPartitions("range", "tail", "down")


def compare_neighbours(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Fingerprints of every text and of its edit towards the next document, and their likeness.

    The edit replaces the last third of the code points by as many first ones
    of the next document in descending key order (after the last: the first).
    Keys may be of any type that can be sorted.  Null texts are empty; rows
    without key come last; rows of one key, or without, are ordered by a hash of
    the text, and equal rows follow each other.  A single row is its own
    neighbour; an empty table gives no rows.
    Columns: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next.
    """
    schema = T.StructType(
        [
            T.StructField("doc_id", docs.schema[key].dataType),
            T.StructField("n_chars", T.LongType()),
            *[T.StructField(c, T.StringType()) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")],
            *[T.StructField(c, T.DoubleType()) for c in ("near_edited", "near_next")],
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # (range, doc_id, text, fingerprint) of the row that waits for its neighbour
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        kinds = [arrow_type(schema["doc_id"].dataType), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        for batch in batches:
            out = []
            ranges, tails, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist()
            for k, of in enumerate(ranges):
                if tails[k] and (held is None or held[0] != of):
                    continue
                words = batch.column(4)[k].as_py()
                mark = fingerprint(words.encode())
                if held is not None and held[0] == of:
                    _, doc, own, own_mark = held
                    third = len(own) // 3
                    edited = (own[: len(own) - third] + words[:third]).encode()
                    edited_mark = fingerprint(edited)
                    out.append((doc, len(own), hashlib.sha256(edited).hexdigest(), own_mark, edited_mark, likeness(own_mark, edited_mark), likeness(own_mark, mark)))
                held = None if tails[k] else (of, ids[k], words, mark)
            columns = list(zip(*out)) if out else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)

    return map_batches(_dealt_in_order(docs, text, key), run, schema)


def op2_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract query: fingerprints of every text and of its edited text.

    Nulls, ties, equal rows and empty tables: as in compare_neighbours.
    """
    return compare_neighbours(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
