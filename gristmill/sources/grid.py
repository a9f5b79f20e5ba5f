"""Files as grids of text cells: CSV, TSV and spreadsheets, and the promotion of a grid to a table.

grid: table_id, row_idx, cells array<string>.  Rows may be ragged; order is in row_idx.
"""

from __future__ import annotations

import codecs
import io
import re
import zipfile
from collections.abc import Iterator
from functools import reduce
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.missing import strip
from .quoted import _batches, _schema, read_quoted, rows_of

#: Extensions that are read, and those of images that are passed over.
TABLES = {".csv": ",", ".tsv": "\t"}
TEXTS = (".txt",)
IMAGES = (".eps", ".gif", ".jpg", ".jpeg", ".png", ".tif", ".tiff", ".svg")
SUPPLEMENTS = (".xlsx", ".csv", ".tsv")

GRID = T.StructType([T.StructField("table_id", T.StringType()), T.StructField("row_idx", T.LongType()), T.StructField("cells", T.ArrayType(T.StringType()))])
#: A file of no more bytes is read whole: one pass over many small files, and no plan of ranges for each.
WHOLE_BYTES = 1 << 20
#: Rows of a grid that one task numbers.
SPAN_ROWS = 1 << 16
PARTS = "name string, status string, reason string, text string, table_id string, row_idx long, cells array<string>"


def _column(ref: str) -> int:
    n = 0
    for ch in re.match("[A-Z]+", ref)[0]:
        n = 26 * n + ord(ch) - 64
    return n - 1


def workbook(blob: bytes) -> list[tuple[str, list[list[str]]]]:
    """(sheet, rows) of a spreadsheet, cached values as text, in the workbook's order."""
    main = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    link = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
    with zipfile.ZipFile(io.BytesIO(blob)) as z:
        shared: list[str] = []
        if "xl/sharedStrings.xml" in z.namelist():
            for item in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{main}si"):
                shared.append("".join(t.text or "" for t in item.iter(f"{main}t")))
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        out = []
        for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{main}sheet"):
            path = targets[sheet.get(link)].lstrip("/")
            root = ElementTree.fromstring(z.read(path if path.startswith("xl/") else f"xl/{path}"))
            rows: dict[int, dict[int, str]] = {}
            for k, row in enumerate(root.iter(f"{main}row")):
                line = rows.setdefault(int(row.get("r", k + 1)) - 1, {})
                for j, cell in enumerate(row.iter(f"{main}c")):
                    value, kind = cell.find(f"{main}v"), cell.get("t")
                    if kind == "inlineStr":
                        text = "".join(t.text or "" for t in cell.iter(f"{main}t"))
                    elif value is None or value.text is None:
                        text = ""
                    elif kind == "s":
                        text = shared[int(value.text)]
                    elif kind == "b":
                        text = "True" if value.text == "1" else "False"
                    else:
                        text = value.text
                    line[_column(cell.get("r")) if cell.get("r") else j] = text
            height = max(rows, default=-1) + 1
            out.append((sheet.get("name"), [[rows.get(i, {}).get(j, "") for j in range(max(rows.get(i, {}), default=-1) + 1)] for i in range(height)]))
    return out


def _parts(name: str, blob: bytes) -> Iterator[tuple]:
    """Rows of PARTS for one file that is read whole: its tables, its text, or why it is passed over."""
    suffix = _suffix(name)
    try:
        if suffix in IMAGES:
            yield name, "skipped", f"image ({suffix})", None, None, None, None
            return
        if suffix in TABLES:
            sheets = [(name, rows_of(blob.removeprefix(codecs.BOM_UTF8).decode("utf-8", "replace"), TABLES[suffix]))]
        elif suffix == ".xlsx":
            found = workbook(blob)
            sheets = [(f"{name}::{s}" if len(found) > 1 else name, rows) for s, rows in found]
        elif suffix in TEXTS:
            yield name, "text", None, blob.decode("utf-8", "replace"), None, None, None
            return
        elif suffix == ".pdf":
            yield name, "skipped", "no PDF reader is installed", None, None, None, None
            return
        else:
            yield name, "skipped", f"unsupported file type {suffix!r}", None, None, None, None
            return
    except Exception as error:  # a broken file must not stop the others
        yield name, "skipped", f"{type(error).__name__}: {error}", None, None, None, None
        return
    yield name, "table", None, None, None, None, None
    for table, rows in sheets:
        for i, row in enumerate(rows):
            yield name, "table", None, None, table, i, row


def _suffix(name: str) -> str:
    return f".{name.rsplit('.', 1)[-1].lower()}" if "." in name else ""


def _exactly(path: str) -> str:
    """A path of which no character is a pattern."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def read_files(spark: SparkSession, path: str | list[str], glob: str | None = None) -> DataFrame:
    """Rows of PARTS for all files of a folder: one that names each file's status, and one for each grid row.

    Delimited files beyond WHOLE_BYTES are read in byte ranges, so a large one is
    many tasks' work; any other file is a row of one task, small ones many to a
    task.  The driver holds a name for each file beyond WHOLE_BYTES.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    listed = (reader.option("pathGlobFilter", glob) if glob else reader).load(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = (file for batch in batches for file in zip(batch.column(0).to_pylist(), batch.column(1)))
        return _batches((row for file, blob in files for row in _parts(file.rsplit("/", 1)[-1], blob.as_py())), _schema(PARTS))

    small = listed.where(F.col("length") <= WHOLE_BYTES).select("path", "content")
    out = [small.hint("rebalance", spark.sparkContext.defaultParallelism).mapInArrow(run, PARTS)]  # a scan's task holds some 30 files, however small
    paths = [r.path for r in listed.where(F.col("length") > WHOLE_BYTES).select("path").collect()]
    rest = [p for p in paths if _suffix(p) not in TABLES]
    if rest:
        out.append(spark.read.format("binaryFile").load([_exactly(p) for p in rest]).select("path", "content").mapInArrow(run, PARTS))
    for suffix, delimiter in TABLES.items():
        tables = [p for p in paths if _suffix(p) == suffix]
        if tables:
            names = [(p.rsplit("/", 1)[-1], "table", None, None, None, None, None) for p in tables]
            rows = read_quoted(spark, [_exactly(p) for p in tables], delimiter)
            name = F.url_decode(F.replace(F.regexp_extract("file", "([^/]*)$", 1), F.lit("+"), F.lit("%2B")))
            none = F.lit(None).cast("string")
            body = rows.select(name.alias("name"), F.lit("table").alias("status"), none.alias("reason"), none.alias("text"), name.alias("table_id"), "row_idx", "cells")
            out += [spark.createDataFrame(names, PARTS), body]
    return reduce(DataFrame.unionByName, out)


def grids(parts: DataFrame) -> DataFrame:
    return parts.where("row_idx IS NOT NULL").select("table_id", "row_idx", "cells")


def ingest_log(parts: DataFrame) -> DataFrame:
    """(name, status, reason) of every file."""
    return parts.where("row_idx IS NULL").select("name", "status", "reason")


def texts(parts: DataFrame, source: str = "local") -> DataFrame:
    """(name, block): texts with a line before them that names their file."""
    rows = parts.where("status = 'text'")
    return rows.select("name", F.format_string(f"--- SUPPLEMENTARY FILE: %s (source: {source}) ---\n%s", "name", strip(F.col("text"))).alias("block"))


def first_by_basename(files: DataFrame, name: str = "name", priority: str = "priority") -> DataFrame:
    """Of files whose names are equal but for case, those of the first source."""
    rest = [c for c in files.columns if c != name]
    return files.groupBy(F.lower(name).alias("__n")).agg(F.min_by(F.struct(name, *rest), F.struct(priority, name)).alias("x")).select("x.*")


def cleaned(grid: DataFrame) -> DataFrame:
    """The grid with stripped cells, without blank rows, padded to each table's width; row_idx counts from 0 again.

    Rows are counted by spans of their old numbers first; sums over the spans
    give each span's first number, so a large table is numbered by many tasks.
    """
    span = F.floor(F.col("row_idx") / SPAN_ROWS)
    bare = grid.withColumn("cells", F.transform("cells", lambda c: F.coalesce(strip(c), F.lit("")))).where(F.exists("cells", lambda c: c != "")).withColumn("span", span)
    spans = bare.groupBy("table_id", "span").agg(F.count("*").alias("n"), F.max(F.size("cells")).alias("w"))
    table = Window.partitionBy("table_id")
    before = table.orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    first = spans.select("table_id", "span", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"), F.max("w").over(table).alias("width"))
    place = F.col("base") + F.row_number().over(Window.partitionBy("table_id", "span").orderBy("row_idx")) - 1
    padded = F.concat("cells", F.array_repeat(F.lit(""), (F.col("width") - F.size("cells")).cast("int")))
    return bare.join(first, ["table_id", "span"]).select("table_id", place.cast("bigint").alias("row_idx"), padded.alias("cells"))


def header_names(cells: Column) -> Column:
    """Unique column names of a header row: blanks are numbered by place, repeats by their count."""
    named = F.transform(cells, lambda c, i: F.when(c == "", F.concat(F.lit("col_"), i.cast("string"))).otherwise(c))

    def nth(c: Column, i: Column) -> Column:
        before = F.size(F.filter(F.slice(named, 1, i), lambda x: x == c))
        return F.when(before > 0, F.concat(c, F.lit("_"), before.cast("string"))).otherwise(c)

    return F.transform(named, nth)


def promote(grid: DataFrame) -> DataFrame:
    """(table_id, columns, n_rows, width) of the grids that make a table: two rows that are not blank, and a header that is not."""
    clean = cleaned(grid)
    out = clean.groupBy("table_id").agg(
        F.max(F.when(F.col("row_idx") == 0, F.col("cells"))).alias("header"), (F.count("*") - 1).alias("n_rows"), F.max(F.size("cells")).alias("width")
    )
    fit = out.where("n_rows > 0").where(F.exists("header", lambda c: c != ""))
    return fit.select("table_id", header_names(F.col("header")).alias("columns"), "n_rows", F.col("width").cast("bigint").alias("width"))


def cells_of(grid: DataFrame) -> DataFrame:
    """Body cells of promoted grids: table_id, row_idx (from 0), col_idx, col, value."""
    clean = cleaned(grid)
    tables = promote(grid).select("table_id", "columns")
    body = clean.where("row_idx > 0").join(tables, "table_id")
    long = body.select("table_id", (F.col("row_idx") - 1).alias("row_idx"), "columns", F.posexplode("cells").alias("col_idx", "value"))
    return long.select("table_id", "row_idx", "col_idx", F.get("columns", F.col("col_idx")).alias("col"), "value")


def table(grid: DataFrame, columns: list[str]) -> DataFrame:
    """One promoted grid as a wide table with row_idx."""
    body = cleaned(grid).where("row_idx > 0")
    return body.select((F.col("row_idx") - 1).alias("row_idx"), *[F.col("cells")[i].alias(c) for i, c in enumerate(columns)])


def manifest(lines: DataFrame, line: str = "value", order: str = "row_idx") -> DataFrame:
    """Grid rows of a tab-separated manifest: no quoting, cells not stripped, empty lines passed over."""
    return lines.where(F.col(line) != "").select(F.col(order).alias("row_idx"), F.split(line, "\t", -1).alias("cells"))
