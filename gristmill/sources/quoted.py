"""Quoted, delimited files of any size, read in byte ranges.

Spark's text reader cuts files into ranges at line ends, but a quoted cell may
hold line ends, so where a row ends depends on all that comes before.  At a line
end there are two states only: between rows, or inside a quoted cell.  A first
pass runs over every range from either state and notes the state it ends in and
how many rows it starts; the ranges of a file are then chained, and a second
pass reads every range from its true state.  Rows that run over range ends are
put together from their pieces.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The most characters of a cell: what a C long holds everywhere.
CELL_LIMIT = 2**31 - 1
_RANGES = "file string, start long, size long, bytes long, ends0 boolean, rows0 long, bare0 boolean, ends1 boolean, rows1 long, bare1 boolean"
_CHAINED = "file string, start long, inside boolean, ends boolean, row long, open_row long, bare boolean, last_open long"
_READ = "file string, row_idx long, cells array<string>, piece string, at long"
_BATCH = 2 << 20


def rows_of(text: str, delimiter: str) -> list[list[str]]:
    """Rows of a whole text; ragged rows stay ragged, cells may be of any length."""
    csv.field_size_limit(CELL_LIMIT)
    return list(csv.reader(io.StringIO(text, newline=""), delimiter=delimiter))


def after_line(line: str, delimiter: str, inside: bool) -> tuple[bool, bool]:
    """(whether a quoted cell is open after the line; whether a carriage return within it ends a row).

    A quote opens a cell only as its first character; doubled, it stays in it.
    """
    if '"' not in line and (inside or "\r" not in line[:-1]):
        return inside, False
    at, bare = 0, False
    while True:
        if not inside:
            if line[at : at + 1] != '"':
                cell, row = line.find(delimiter, at), line.find("\r", at, len(line) - 1)
                bare |= row >= 0 and not 0 <= cell < row
                if cell < 0:
                    return False, bare
                at = cell + 1
                continue
            at += 1
        close = line.find('"', at)
        while close >= 0 and line[close + 1 : close + 2] == '"':
            close = line.find('"', close + 2)
        if close < 0:
            return True, bare
        cell, row = line.find(delimiter, close + 1), line.find("\r", close + 1, len(line) - 1)
        bare |= row >= 0 and not 0 <= cell < row
        if cell < 0:
            return False, bare
        inside, at = False, cell + 1


def _schema(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}
    return pa.schema([(name, kinds[kind]) for name, kind in (part.split(" ") for part in ddl.split(", "))])


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows as batches of a bounded number of characters."""
    some, size = [], 0
    for row in rows:
        some.append(row)
        size += 64 + sum(len(x) if isinstance(x, str) else sum(map(len, x)) if isinstance(x, list) else 0 for x in row)
        if size > _BATCH:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some), schema)], schema=schema)
            some, size = [], 0
    if some:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some), schema)], schema=schema)


def _lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    read = spark.read.option("lineSep", "\n").text(paths)
    place = [F.col(f"_metadata.{name}").alias(alias) for name, alias in (("file_path", "file"), ("file_block_start", "start"), ("file_size", "size"))]
    return read.select(*place, F.col("value").cast("binary").alias("line"))


def _by_range(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, Iterator[bytes]]]:
    """((file, start, size), its lines) of each range that a task reads; ranges come one after another."""
    rows = ((tuple(place), line) for b in batches for *place, line in zip(*(b.column(i).to_pylist() for i in range(4))))
    head = next(rows, None)

    def lines(key: tuple) -> Iterator[bytes]:
        nonlocal head
        while head is not None and head[0] == key:
            line, head = head[1], next(rows, None)
            yield line

    while head is not None:
        key = head[0]
        inner = lines(key)
        yield key, inner
        for _ in inner:
            pass


def _survey(lines: DataFrame, delimiter: str) -> DataFrame:
    """A row of _RANGES for each range: from either state, the state it ends in, the rows it starts, and if a carriage return ends a row."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for key, text in _by_range(batches):
            state, started, bare, size = [False, True], [0, 0], [False, False], 0
            for raw in text:
                size += len(raw) + 1
                line = raw.decode("utf-8", "replace")
                for s in (0, 1):
                    started[s] += not state[s]
                    state[s], odd = after_line(line, delimiter, state[s])
                    bare[s] |= odd
            yield (*key, size, state[0], started[0], bare[0], state[1], started[1], bare[1])

    return lines.mapInArrow(lambda batches: _batches(rows(batches), _schema(_RANGES)), _RANGES)


def _chain(ranges: pd.DataFrame) -> pd.DataFrame:
    """The ranges of one file in order, each from the state in which the one before it ends.

    row: rows of the file that start before the range; open_row: the row that is
    open at its start; last_open: the row that the file's end leaves open
    without a line feed, else -1.
    """
    out, inside, row, open_row, bare = [], False, 0, -1, False
    for r in ranges.sort_values("start").itertuples():
        ends, started, odd = (r.ends1, r.rows1, r.bare1) if inside else (r.ends0, r.rows0, r.bare0)
        out.append([r.file, r.start, inside, ends, row, open_row])
        row, inside, bare = row + started, ends, bare or odd
        open_row = row - 1
    last = open_row if inside and ranges["bytes"].sum() == ranges["size"].iloc[0] + 1 else -1
    return pd.DataFrame([[*x, bare, last] for x in out], columns=_schema(_CHAINED).names)


def _read(lines: DataFrame, chained: dict[tuple[str, int], tuple], delimiter: str) -> DataFrame:
    """Rows of _READ: rows with their cells, and of rows that run over range ends the pieces, by range."""

    def pieces(key: tuple, text: Iterator[bytes]) -> Iterator[tuple]:
        file, start, _ = key
        inside, ends, k, open_row, bare, _ = chained[file, start]
        if bare:
            return
        source = (raw.decode("utf-8", "replace") for raw in text)
        head = []
        while inside and (line := next(source, None)) is not None:
            head.append(line + "\n")
            inside, _ = after_line(line, delimiter, True)
        if head:
            yield file, open_row, None, "".join(head), start
        taken: list[str] = []

        def feed() -> Iterator[str]:
            for line in source:
                taken.append(line + "\n")
                yield taken[-1]

        held = None
        for cells in csv.reader(feed(), delimiter=delimiter):
            if held is not None:
                yield file, k, held[0], None, None
                k += 1
            held = cells, "".join(taken) if ends else ""
            taken.clear()
        if held is not None:
            yield (file, k, None, held[1], start) if ends else (file, k, held[0], None, None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        csv.field_size_limit(CELL_LIMIT)
        rows = (row for key, text in _by_range(batches) for row in pieces(key, text))
        yield from _batches(rows, _schema(_READ))

    return lines.mapInArrow(run, _READ)


def read_quoted(spark: SparkSession, paths: list[str], delimiter: str) -> DataFrame:
    """(file, row_idx, cells) of quoted, delimited files, as a csv reader gives them for the whole text.

    Bad UTF-8 is replaced, ragged rows stay ragged, an empty line is a row
    without cells, an empty file has no rows.  A task reads a byte range; the
    driver holds and broadcasts a row for each of them (some hundred bytes for
    spark.sql.files.maxPartitionBytes of input).  A row that runs over ranges is
    put together in memory.  Files in which lone carriage returns end rows are
    read whole, each by a task.
    """
    lines = _lines(spark, paths)
    ranges = _survey(lines, delimiter).groupBy("file").applyInPandas(_chain, _CHAINED).collect()
    chained = {(r.file, r.start): tuple(r)[2:] for r in ranges}
    last = {r.file: r.last_open for r in ranges}
    read = _read(lines, chained, delimiter)
    whole = read.where("piece IS NULL").select("file", "row_idx", "cells")
    out = whole
    if any(r.ends for r in ranges):
        parts = read.where("piece IS NOT NULL").groupBy("file", "row_idx").agg(F.array_sort(F.collect_list(F.struct("at", "piece"))).alias("p"))

        def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def rows() -> Iterator[tuple]:
                for batch in batches:
                    for file, k, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                        yield file, k, rows_of(text[:-1] if last[file] == k else text, delimiter)[0]

            yield from _batches(rows(), _schema("file string, row_idx long, cells array<string>"))

        joined = parts.select("file", "row_idx", F.array_join(F.transform("p", lambda x: x["piece"]), "").alias("text"))
        out = out.unionByName(joined.mapInArrow(join, "file string, row_idx long, cells array<string>"))
    bare = sorted({r.file for r in ranges if r.bare})
    if bare:

        def at_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def rows() -> Iterator[tuple]:
                for batch in batches:
                    for file, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                        for k, cells in enumerate(rows_of(blob.as_py().decode("utf-8", "replace"), delimiter)):
                            yield file, k, cells

            yield from _batches(rows(), _schema("file string, row_idx long, cells array<string>"))

        blobs = spark.read.format("binaryFile").load(bare).select(F.col("_metadata.file_path").alias("file"), "content")
        out = out.unionByName(blobs.mapInArrow(at_once, "file string, row_idx long, cells array<string>"))
    return out
