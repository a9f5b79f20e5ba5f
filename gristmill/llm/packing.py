"""Packing by concatenate and cut.

Pass 1 tokenizes every document once and writes its ids with the place it has
among the tokens of its task.  A prefix sum over the tasks' totals turns that
place into a global offset.  Pass 2 cuts the stream at fixed windows; a document
that crosses a window's edge leaves a boundary record on either side.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._store import map_batches, materialize
from ._text import Words, slabs

WINDOW = 2048
END_ID = 1
TOKENIZER = "word_bpe_49k.json"
#: Distinct words that a process remembers; a full memory is emptied, which changes no result.
MEMORY_WORDS = 1_000_000
#: Tokens that one step of a task handles at once.
STEP_TOKENS = 1 << 19
_MARK = "|"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordTokenizer:
    """Ids of whole texts from a tokenizer whose white space only separates.

    Such a tokenizer gives a text the ids of its words in turn, so each distinct
    word is encoded once and a text is assembled from the words' ids.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self._empty()

    def _empty(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.first = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int32)
        self.ids = np.zeros(0, np.uint32)

    def _encode_words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in turn, number of ids of each); words are joined by a mark to save calls."""
        mark = self.tokenizer.encode(_MARK, add_special_tokens=False).ids
        marked = np.array([_MARK in t for t in texts])
        if len(mark) == 1 and not marked.any():
            lines = [f" {_MARK} ".join([*texts[i : i + 1000], ""]) for i in range(0, len(texts), 1000)]
            flat = np.concatenate([np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(lines, add_special_tokens=False)])
            ends = np.flatnonzero(flat == mark[0])
            if len(ends) == len(texts):
                return flat[flat != mark[0]], np.diff(ends, prepend=-1) - 1
        encoded = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        size = np.fromiter(map(len, encoded), np.int64, len(encoded))
        return np.fromiter((i for e in encoded for i in e), np.uint32, int(size.sum())), size

    def _learn(self, words: Words, at: np.ndarray, keys: np.ndarray) -> None:
        texts = np.array([words.word_bytes(i).decode("utf-8", "replace") for i in at], object)
        marked = np.array([_MARK in t for t in texts])
        for of in (marked, ~marked):
            if not of.any():
                continue
            order = np.argsort(keys[of])
            new = keys[of][order]
            flat, size = self._encode_words(texts[of][order].tolist())
            place = np.searchsorted(self.keys, new)
            self.first = np.insert(self.first, place, len(self.ids) + np.cumsum(size) - size)
            self.size = np.insert(self.size, place, size)
            self.keys = np.insert(self.keys, place, new)
            self.ids = np.concatenate([self.ids, flat])

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in turn, offsets of n + 1 texts), without end ids."""
        words = Words(column, lower=False)
        coded = pa.array(words.key).dictionary_encode()
        unique, inverse = coded.dictionary.to_numpy(), coded.indices.to_numpy()
        if len(self.keys) > MEMORY_WORDS:
            self._empty()
        known = np.zeros(len(unique), bool)
        if len(self.keys):
            place = np.minimum(np.searchsorted(self.keys, unique), len(self.keys) - 1)
            known = self.keys[place] == unique
        if not known.all():
            seen_at = np.zeros(len(unique), np.int64)
            seen_at[inverse[::-1]] = np.arange(len(inverse) - 1, -1, -1)
            self._learn(words, seen_at[~known], unique[~known])
        place = np.searchsorted(self.keys, unique)
        size = self.size[place][inverse]
        stop = np.cumsum(size, dtype=np.int64)
        source = np.repeat(self.first[place][inverse] - (stop - size), size)
        source += np.arange(len(source))
        return self.ids[source], np.concatenate([[0], stop])[words.ptr]


_TOOLS: dict[str, WordTokenizer] = {}


def word_tokenizer(path: str) -> WordTokenizer:
    """The process's tokenizer for this file; what it has learned serves later tasks too."""
    if path not in _TOOLS:
        _TOOLS[path] = WordTokenizer(path)
    return _TOOLS[path]


def width_of(path: str) -> int:
    """Bytes that hold any id of this tokenizer."""
    return 2 if word_tokenizer(path).tokenizer.get_vocab_size() <= 1 << 16 else 4


def tokenize(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """One row for each document: `keep`, ids (little-endian, `width_of(path)` bytes each), n, task, place.

    place is the number of tokens that the task gave out before; a null or
    empty text has the end id alone.
    """
    path = path or tokenizer_path()
    width = width_of(path)
    fields = [T.StructField(f"k{i}", docs.schema[c].dataType) for i, c in enumerate(keep)]
    schema = T.StructType(
        [*fields, T.StructField("ids", T.BinaryType()), T.StructField("n", T.LongType()), T.StructField("task", T.LongType()), T.StructField("place", T.LongType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, task, given = word_tokenizer(path), TaskContext.get().partitionId(), 0
        for batch in batches:
            column = batch.column(len(keep))
            for lo, hi in slabs(column):
                ids, off = tool.encode(column.slice(lo, hi - lo))
                n = np.diff(off) + 1
                end = np.cumsum(n)
                stream = np.full(int(end[-1]), end_id, "<u4")
                inner = np.ones(len(stream), bool)
                inner[end - 1] = False
                stream[inner] = ids
                raw = pa.py_buffer(stream.astype(f"<u{width}").tobytes())
                bounds = pa.py_buffer(np.concatenate([[0], end * width]).astype(np.int32).tobytes())
                packed = pa.Array.from_buffers(pa.binary(), len(n), [None, bounds, raw])
                arrays = [batch.column(i).slice(lo, hi - lo) for i in range(len(keep))]
                arrays += [packed, pa.array(n), pa.array(np.full(len(n), task, np.int64)), pa.array(given + end - n)]
                given += int(end[-1])
                yield pa.RecordBatch.from_arrays(arrays, schema.names)

    picked = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(text).cast("string").alias("text"))
    return map_batches(picked, run, schema)


def pack(
    docs: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    window: int = WINDOW,
    path: str | None = None,
    end_id: int = END_ID,
    with_ids: bool = True,
) -> DataFrame:
    """Packs all documents into sequences of `window` tokens; one row for each piece of a document.

    Columns: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset,
    and ids (array<int>) if asked.  Only the last sequence can be short.  The
    order of documents is that of the tasks that read them; repeated rows and
    null keys are packed like any other, a null or empty text as its end id.
    """
    path = path or tokenizer_path()
    width = width_of(path)
    stored = materialize(tokenize(docs, text, (key,), path, end_id), "tokens")
    totals = {r.task: r.n for r in stored.groupBy("task").agg(F.sum("n").alias("n")).collect()}  # a row a task
    tasks = np.array(sorted(totals), np.int64)
    base = np.concatenate([[0], np.cumsum([totals[t] for t in tasks])]).astype(np.int64)
    schema = T.StructType(
        [
            T.StructField("doc_id", docs.schema[key].dataType),
            *[T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")],
            *([T.StructField("ids", T.ArrayType(T.IntegerType()))] if with_ids else []),
        ]
    )

    def pieces_of(batch: pa.RecordBatch, n: np.ndarray) -> pa.RecordBatch:
        from zlib import crc32

        begin = base[np.searchsorted(tasks, batch.column(3).to_numpy())] + batch.column(4).to_numpy()
        sequence = begin // window
        pieces = (begin + n - 1) // window - sequence + 1
        row = np.repeat(np.arange(len(n)), pieces)
        which = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        at = np.maximum(begin[row], (sequence[row] + which) * window)
        to = np.minimum((begin + n)[row], (sequence[row] + which + 1) * window)
        start, length = at - begin[row], to - at
        docs_ids = [np.frombuffer(b.as_buffer(), f"<u{width}").astype("<u4") for b in batch.column(1)]
        parts = [docs_ids[r][s : s + m] for r, s, m in zip(row.tolist(), start.tolist(), length.tolist())]
        arrays = [batch.column(0).take(pa.array(row)), pa.array(start), pa.array(length), pa.array([crc32(p) for p in parts], pa.int64())]
        arrays += [pa.array(n[row]), pa.array(at // window), pa.array(at % window)]
        if with_ids:
            bounds = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
            arrays.append(pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate(parts).astype(np.int32))))
        return pa.RecordBatch.from_arrays(arrays, schema.names)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column(2).to_numpy()
            total = np.cumsum(n)
            lo = 0
            while lo < len(n):
                hi = max(lo + 1, int(np.searchsorted(total, total[lo] - n[lo] + STEP_TOKENS, "right")))
                yield pieces_of(batch.slice(lo, hi - lo), n[lo:hi])
                lo = hi

    return map_batches(stored, cut, schema)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract query: the pieces of all documents, described but without their ids.

    Nulls, equal rows and empty tables: as in pack.
    """
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), with_ids=False)
