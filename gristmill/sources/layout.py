"""Tables and text of pages given as positioned words, as a PDF reader gives them.

words: doc, page, text, x0, top, x1, bottom (points, from the top left corner).
A line is a cluster of words whose tops lie close together; within a line, words
closer than a blank's width make a cell.  Lines of two cells or more in a row
make a table; its columns are the clusters of its cells' spans across.  All
clusters are gaps found by windows over a page, so pages are worked on by many
tasks, however long a document is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.tables import inside

#: Tops of a line differ by less, and cells of a line stand further apart (points).
LINE_GAP, CELL_GAP = 3.0, 9.0
LEAST_ROWS, LEAST_CELLS = 2, 2
_PAGE = ("doc", "page")


def _islands(by: list[str], order: list[Column], new: Column) -> Column:
    """A number for each row of a group, which grows wherever `new` says that a cluster begins."""
    return F.sum(F.coalesce(new, F.lit(False)).cast("int")).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))


def cells(words: DataFrame, line_gap: float = LINE_GAP, cell_gap: float = CELL_GAP) -> DataFrame:
    """(doc, page, line, cell, text, x0, top, x1, bottom): words joined to cells, lines and cells counted from 0."""
    down = [F.col("top"), F.col("x0"), F.col("text")]
    before = Window.partitionBy(*_PAGE).orderBy(*down)
    lined = words.withColumn("line", _islands(list(_PAGE), down, F.col("top") - F.lag("top").over(before) > line_gap))
    across = [F.col("x0"), F.col("x1"), F.col("text")]
    in_line = Window.partitionBy(*_PAGE, "line").orderBy(*across)
    reach = F.max("x1").over(in_line.rowsBetween(Window.unboundedPreceding, -1))
    celled = lined.withColumn("gap", F.col("x0") - reach > cell_gap)
    celled = celled.withColumn("cell", _islands([*_PAGE, "line"], across, F.col("gap")))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "x1", "text"))), lambda w: w["text"]), " ")
    return celled.groupBy(*_PAGE, "line", "cell").agg(joined.alias("text"), F.min("x0").alias("x0"), F.min("top").alias("top"), F.max("x1").alias("x1"), F.max("bottom").alias("bottom"))


def _in_tables(found: DataFrame, least_rows: int, least_cells: int) -> DataFrame:
    """The cells of lines that make tables, with the number of their table on the page, from 1."""
    lines = found.groupBy(*_PAGE, "line").agg((F.count("*") >= least_cells).alias("row"))
    order = Window.partitionBy(*_PAGE).orderBy("line")
    run = lines.withColumn("run", F.sum((F.col("row") != F.coalesce(F.lag("row").over(order), F.lit(False))).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))).where("row")
    runs = run.groupBy(*_PAGE, "run").agg(F.count("*").alias("n")).where(F.col("n") >= least_rows)
    numbered = runs.withColumn("table", F.row_number().over(Window.partitionBy(*_PAGE).orderBy("run")))
    return found.join(run.join(numbered.select(*_PAGE, "run", "table"), [*_PAGE, "run"]).select(*_PAGE, "line", "table"), [*_PAGE, "line"])


def page_tables(found: DataFrame, least_rows: int = LEAST_ROWS, least_cells: int = LEAST_CELLS) -> DataFrame:
    """(table_id, row_idx, cells) of all tables of cells(): a grid a table, named doc::p<page>_t<number>.

    Cells whose spans overlap from line to line are one column; two cells of a
    line in one column are joined by a blank.  What a line lacks is ''.
    """
    inner = _in_tables(found, least_rows, least_cells)
    by = [*_PAGE, "table"]
    across = [F.col("x0"), F.col("x1"), F.col("line")]
    reach = F.max("x1").over(Window.partitionBy(*by).orderBy(*across).rowsBetween(Window.unboundedPreceding, -1))
    columned = inner.withColumn("new", F.col("x0") > reach).withColumn("column", _islands(by, across, F.col("new")))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "text"))), lambda c: c["text"]), " ")
    one = columned.groupBy(*by, "line", "column").agg(joined.alias("text"))
    widths = one.groupBy(*by).agg((F.max("column") + 1).alias("width"), F.min("line").alias("first"))
    rows = one.groupBy(*by, "line").agg(F.map_from_entries(F.collect_list(F.struct("column", "text"))).alias("m")).join(widths, by)
    texts = F.transform(F.sequence(F.lit(0), F.col("width").cast("int") - 1), lambda i: F.coalesce(F.try_element_at("m", i.cast("long")), F.lit("")))
    name = F.format_string("%s::p%s_t%s", F.col("doc").cast("string"), F.col("page").cast("string"), F.col("table").cast("string"))
    return rows.select(name.alias("table_id"), (F.col("line") - F.col("first")).cast("bigint").alias("row_idx"), texts.alias("cells"))


def page_texts(found: DataFrame, least_rows: int = LEAST_ROWS, least_cells: int = LEAST_CELLS) -> DataFrame:
    """(doc, page, text): the lines of each page without what lies in the box of a table; pages that are all tables have no row."""
    inner = _in_tables(found, least_rows, least_cells)
    boxes = inner.groupBy(*_PAGE, "table").agg(F.min("x0").alias("a"), F.min("top").alias("b"), F.max("x1").alias("c"), F.max("bottom").alias("d"))
    listed = boxes.groupBy(*_PAGE).agg(F.collect_list(F.struct("a", "b", "c", "d")).alias("boxes"))
    here = [F.col(c) for c in ("x0", "top", "x1", "bottom")]
    joined = found.join(listed, list(_PAGE), "left")
    out = joined.where(~F.coalesce(F.exists("boxes", lambda x: inside((x["a"], x["b"], x["c"], x["d"]), *here)), F.lit(False)))
    lines = out.groupBy(*_PAGE, "line").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("cell", "text"))), lambda c: c["text"]), " ").alias("text"))
    return lines.groupBy(*_PAGE).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n").alias("text"))
