"""Vector code compression: product codes by exact integer arithmetic.

Components become integers, a vector is cut into equal parts, and every part is
replaced by the index of the nearest entry of its codebook.  Codebooks start as
the parts of the first vectors and move to their parts' means, rounded down, a
fixed number of rounds.

Nearest entries come from dot products that are exact: integers are broken into
limbs, so few bits each that a float64 matrix product over a part stays below
2^53; the products of limbs are shifted and summed in int64, and the first least
distance wins.  Executors get the codebooks, whose size the parameters fix, and
give back sums by part and entry; sums of all tasks are added as decimals.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._store import map_batches, materialize

#: Fixed by the contract.
SCALE = 256
PARTS = 16
ENTRIES = 64
ROUNDS = 2
#: Squared distances must fit in 63 bits.
MOST_BITS = 62
#: A label with at least this share of the rows has its sum broadcast; there can be no more such labels than 1 / share.
HOT_SHARE = 1 / 2000


def limbs(values: np.ndarray, bits: int) -> list[np.ndarray]:
    """Float arrays x0, x1, ... with values = sum of x_k * 2^(k bits); all but the last lie in 0 .. 2^bits - 1, the last keeps the sign."""
    out, rest = [], values.astype(np.int64)
    while len(out) * bits < 63 and bool(((rest >= 1 << bits) | (rest < -(1 << bits))).any()):
        out.append((rest & ((1 << bits) - 1)).astype(np.float64))
        rest = rest >> bits
    return [*out, rest.astype(np.float64)]


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The int64 product a @ b of integer matrices by float64 products of limbs; exact if the result fits in int64."""
    width = max(1, a.shape[1])
    bits = (52 - (width - 1).bit_length()) // 2  # limbs reach 2^bits at most, so width products stay below 2^53
    out = np.zeros((a.shape[0], b.shape[1]), np.int64)
    right = limbs(b, bits)
    for i, x in enumerate(limbs(a, bits)):
        for k, y in enumerate(right):
            out += (x @ y).astype(np.int64) << (bits * (i + k))
    return out


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the nearest entry, lower index at ties; squared distance) of each row, in int64."""
    own = (parts * parts).sum(axis=1)
    away = (entries * entries).sum(axis=1)[None, :] - 2 * dots(parts, entries.T)
    best = away.argmin(axis=1)
    return best, own + away[np.arange(len(best)), best]


@dataclass(frozen=True)
class Codebooks:
    """entries[part, entry, position]; width: components of a vector."""

    entries: np.ndarray
    width: int

    def digest(self) -> str:
        """sha256 of all components, by part, entry and position, joined by commas."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def whole_vectors(rows: DataFrame, vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """rows with column `ints`, floor(scale * x) of each component, without rows whose vector is null or holds null or non-finite components."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    usable = rows.where(F.col(vector).isNotNull() & ~F.coalesce(odd, F.lit(True)))
    return usable.withColumn("ints", F.transform(vector, lambda x: F.floor(x.cast("double") * scale)))


def _matrix(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows whose vector has `width` components, their matrix)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.diff(column.offsets.to_numpy())
    fit = np.flatnonzero(sizes == width)
    if len(fit) < len(sizes):
        column = column.take(pa.array(fit))
    return fit, column.flatten().to_numpy(zero_copy_only=False).reshape(len(fit), width)


def _checked(values: np.ndarray, part: int) -> np.ndarray:
    most = int(np.abs(values).max(initial=0))
    if 4 * part * most * most >> MOST_BITS:
        raise ValueError(f"components up to {most} give squared distances beyond 63 bits")
    return values


def _sums(vectors: DataFrame, books: Codebooks) -> DataFrame:
    """(part, entry, position, total, count) of the parts nearest to each entry, one row a task before they are added."""
    n_parts, n_entries, part = books.entries.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((n_parts, n_entries, part), object)
        count = np.zeros((n_parts, n_entries), np.int64)
        for batch in batches:
            values = _checked(_matrix(batch.column(0), books.width)[1], part)
            for p in range(n_parts):
                own = values[:, p * part : (p + 1) * part]
                best, _ = nearest(own, books.entries[p])
                order = np.argsort(best, kind="stable")
                used, first = np.unique(best[order], return_index=True)
                if len(used):
                    total[p, used] += np.add.reduceat(own[order], first, axis=0).astype(object)
                count[p] += np.bincount(best, minlength=n_entries)
        p, e = np.nonzero(count)
        rows = [pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array([[str(x) for x in total[i, j]] for i, j in zip(p, e)], pa.list_(pa.string())), pa.array(count[p, e])]
        yield pa.RecordBatch.from_arrays(rows, ["part", "entry", "total", "count"])

    found = map_batches(vectors.select("ints"), run, "part int, entry int, total array<string>, count long")
    flat = found.select("part", "entry", "count", F.posexplode("total").alias("position", "x"))
    return flat.groupBy("part", "entry", "position").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("total"), F.sum("count").alias("count"))


def fit_codebooks(vectors: DataFrame, key: str = "vec_id", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks | None:
    """Codebooks of the rows of whole_vectors(); None where there is no row.

    They start as the parts of the rows with the smallest keys (null keys last,
    equal keys by vector; fewer rows give fewer entries).  In each round every
    part goes to its nearest entry, then entries become floor(sum / count) of
    their parts; entries without parts stay.  The driver holds parts x entries
    rows.  The first row's length counts: it must be a multiple of `parts`.
    """
    first = vectors.orderBy(F.col(key).asc_nulls_last(), "ints").select("ints").limit(entries).collect()
    if not first:
        return None
    width = len(first[0].ints)
    if width % parts or not width:
        raise ValueError(f"vectors of {width} components cannot be cut into {parts} equal parts")
    start = np.array([r.ints for r in first if len(r.ints) == width], np.int64)
    books = Codebooks(np.ascontiguousarray(start.reshape(len(start), parts, -1).transpose(1, 0, 2)), width)
    _checked(books.entries, width // parts)
    for _ in range(rounds):
        moved = books.entries.copy()
        for r in _sums(vectors, books).collect():
            moved[r.part, r.entry, r.position] = int(r.total) // r["count"]
        books = Codebooks(moved, width)
    return books


def encode(vectors: DataFrame, books: Codebooks, keep: tuple[str, ...] = ("vec_id", "label")) -> DataFrame:
    """One row for each vector: columns `keep`, code, error.

    code has two hexadecimal digits a part (as many as the entries need), the
    index of its nearest entry; error is the sum of the squared distances.  Both
    are null where a vector has another length than the codebooks'.
    """
    fields = [T.StructField(f"k{i}", vectors.schema[c].dataType) for i, c in enumerate(keep)]
    schema = T.StructType([*fields, T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    n_parts, n_entries, part = books.entries.shape
    digits = max(2, len(f"{n_entries - 1:x}"))
    names = np.array([f"{e:0{digits}x}" for e in range(n_entries)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fit, values = _matrix(batch.column(len(keep)), books.width)
            _checked(values, part)
            code, error = np.full(len(fit), "", f"<U{digits * n_parts}"), np.zeros(len(fit), np.int64)
            for p in range(n_parts):
                best, far = nearest(values[:, p * part : (p + 1) * part], books.entries[p])
                code = np.char.add(code, names[best])
                error += far
            place = np.full(batch.num_rows, -1, np.int64)
            place[fit] = np.arange(len(fit))
            at = pa.array(place, mask=place < 0)
            found = [pa.array(code.tolist(), pa.string()).take(at), pa.array(error).take(at)]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(keep))] + found, schema.names)

    out = map_batches(vectors.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], "ints"), run, schema)
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "code", "error")


def with_label_errors(coded: DataFrame, label: str = "label") -> DataFrame:
    """coded with label_error, the sum of error over rows of an equal label (nulls are equal).

    Sums of labels with a fair share of the rows are broadcast, as their number
    is bounded by that share; other labels' rows are few each, so they are
    joined by a shuffle.  `coded` is read three times: a written table is best.
    """
    names = [f"c{i}" for i in range(len(coded.columns))]
    plain, of, error = coded.toDF(*names), f"c{coded.columns.index(label)}", f"c{coded.columns.index('error')}"
    sums = plain.groupBy(F.col(of).alias("of")).agg(F.sum(error).alias("label_error"), F.count("*").alias("n"))
    hot = F.broadcast(sums.where(F.col("n") >= max(1.0, coded.count() * HOT_SHARE)).withColumn("hot", F.lit(True)))
    first = plain.join(hot, F.col(of).eqNullSafe(F.col("of")), "left")
    rest = first.where("hot IS NULL").select(*names).join(sums, F.col(of).eqNullSafe(F.col("of")))
    both = first.where("hot").select(*names, "label_error").unionByName(rest.select(*names, "label_error"))
    return both.toDF(*coded.columns, "label_error")


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract query: code, error and its sum by label for every usable vector.

    Null and non-finite vectors are dropped; equal ids stay as rows of their
    own, null ids come last; a vector of another length than the first has null
    code and error; an empty table gives no rows.
    """
    vectors = whole_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label"))
    books = fit_codebooks(vectors)
    if books is None:
        return spark.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    coded = materialize(encode(vectors, books), "coded")
    return with_label_errors(coded).select("vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))


def _round_sql(k: int) -> str:
    """Assignment a{k} of all parts to codebook c{k}, and the codebook c{k+1} that follows."""
    return f"""
b{k} AS (SELECT part, entry, list(v ORDER BY pos) AS cv FROM c{k} GROUP BY part, entry),
a{k} AS (SELECT id, part, pv, min(struct_pack(dist := list_sum(list_transform(list_zip(pv, cv), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, entry := entry)) AS m
         FROM parts JOIN b{k} USING (part) GROUP BY id, part, pv),
c{k + 1} AS (SELECT part, entry, pos, coalesce(s.v, c{k}.v) AS v FROM c{k} LEFT JOIN (
           SELECT part, m.entry AS entry, pos, floor(sum(pv[pos])::DOUBLE / count(*))::BIGINT AS v FROM a{k}, unnest(range(1, len(pv) + 1)) AS t(pos) GROUP BY ALL) s USING (part, entry, pos))"""


OP12_SQL = f"""
WITH kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS ints, row_number() OVER (ORDER BY vec_id) AS id
              FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS (SELECT id, part, ints[part * (len(ints) // 16) + 1 : (part + 1) * (len(ints) // 16)] AS pv FROM kept, unnest(range(16)) AS t(part)),
c0 AS (SELECT part, id - 1 AS entry, pos, pv[pos] AS v FROM parts, unnest(range(1, len(pv) + 1)) AS t(pos) WHERE id <= 64),
{",".join(_round_sql(k) for k in range(ROUNDS + 1))},
coded AS (SELECT id, string_agg(lpad(to_hex(m.entry), 2, '0'), '' ORDER BY part) AS code, sum(m.dist)::BIGINT AS error FROM a{ROUNDS} GROUP BY id)
SELECT vec_id, lower(code) AS code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
       (SELECT sha256(string_agg(v::VARCHAR, ',' ORDER BY part, entry, pos)) FROM c{ROUNDS}) AS codebooks_sha256
FROM coded JOIN kept USING (id)
"""
