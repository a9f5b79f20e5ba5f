"""Queries over files that Spark writes from the tables, one a name, and reads back."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import sinks
from ..shared import scratch, written
from ..sources import grid as grids
from ..sources import layout
from .queries import _map, _t, query


@query("""
WITH d AS (SELECT coalesce(lang, 'none') AS lang, doc_id, coalesce(text, '') AS text FROM documents)
SELECT lang || '.csv' AS table_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS row_idx, doc_id, sha256(text) AS text_sha256, length(text) AS n_chars FROM d""")
def quoted_files(spark, d):
    """Whole documents, line ends and quotes included, as a CSV file for each language."""
    docs = _t(spark, d, "documents")
    folder = scratch(spark)
    name = F.concat(F.coalesce("lang", F.lit("none")), F.lit(".csv"))
    sinks.write_named(docs.select(name.alias("name"), F.col("doc_id").alias("at"), sinks.csv_line([F.col("doc_id"), F.col("text")]).alias("line")).unionByName(
        docs.select(name.alias("name")).distinct().select("name", F.lit(None).cast("long").alias("at"), F.lit("doc_id,text").alias("line"))), folder)
    body = grids.grids(grids.read_files(spark, folder)).where("row_idx > 0")
    id_, text = F.get("cells", F.lit(0)), F.get("cells", F.lit(1))
    return body.select("table_id", "row_idx", id_.cast("long").alias("doc_id"), F.sha2(text, 256).alias("text_sha256"), F.length(text).cast("long").alias("n_chars"))


@query("""
WITH c AS (SELECT 'n' || c_nationkey AS paper_id, c_custkey, CASE WHEN c_nationkey % 2 = 0 OR c_custkey % 3 = 0 THEN c_mktsegment END AS segment, CASE WHEN c_custkey % 3 = 1 THEN 'a "b", ' || c_custkey END AS note, c_nationkey FROM customer),
h AS (SELECT paper_id, bool_or(c_custkey % 3 = 1) AS has_note, bool_or(segment IS NOT NULL) AS has_segment FROM c GROUP BY paper_id)
SELECT paper_id || '.csv' AS table_id, 0::BIGINT AS row_idx, 'paper_id|' || CASE WHEN has_note THEN 'note|' ELSE '' END || 'sample_id' || CASE WHEN has_segment THEN '|segment' ELSE '' END AS line FROM h
UNION ALL SELECT paper_id || '.csv', row_number() OVER (PARTITION BY paper_id ORDER BY c_custkey),
  paper_id || '|' || CASE WHEN has_note THEN coalesce(note, '') || '|' ELSE '' END || c_custkey || CASE WHEN has_segment THEN '|' || coalesce(segment, '') ELSE '' END FROM c JOIN h USING (paper_id)""")
def sample_files(spark, d):
    """A CSV file for each nation, whose header has the keys that its samples have."""
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    note = F.concat(F.lit('a "b", '), k.cast("string"))
    bag = F.map_filter(_map(sample_id=k, segment=F.when((n % 2 == 0) | (k % 3 == 0), F.col("c_mktsegment")), note=F.when(k % 3 == 1, note)), lambda key, v: v.isNotNull())
    folder = scratch(spark)
    sinks.write_sample_files(_t(spark, d, "customer").select(F.concat(F.lit("n"), n.cast("string")).alias("paper_id"), k.alias("row_idx"), bag.alias("values")), folder)
    return grids.grids(grids.read_files(spark, folder)).select("table_id", "row_idx", F.array_join("cells", "|").alias("line"))


_KINDS = {0: (".csv", "table", None), 1: (".TSV", "table", None), 2: (".txt", "text", None), 3: (".png", "skipped", "image (.png)"), 4: (".docx", "skipped", "unsupported file type '.docx'"), 5: (".pdf", "skipped", "no PDF reader is installed")}


@query(
    "WITH s AS (SELECT *, s_suppkey % 6 AS k FROM supplier) SELECT 's' || s_suppkey || CASE k "
    + " ".join(f"WHEN {k} THEN '{suffix}'" for k, (suffix, *_) in _KINDS.items())
    + " END AS name, CASE k "
    + " ".join(f"WHEN {k} THEN '{status}'" for k, (_, status, _) in _KINDS.items())
    + " END AS status, CASE k "
    + " ".join(f"WHEN {k} THEN '" + reason.replace("'", "''") + "'" for k, (*_, reason) in _KINDS.items() if reason)
    + """ END AS reason, CASE WHEN k = 2 THEN '--- SUPPLEMENTARY FILE: s' || s_suppkey || '.txt (source: local) ---' || chr(10) || 'Name' || chr(9) || 'Nation' || chr(10) || s_name || chr(9) || s_nationkey END AS block,
   CASE WHEN k < 2 THEN 2 ELSE 0 END::BIGINT AS n_rows, CASE k WHEN 0 THEN 1 WHEN 1 THEN 2 END::BIGINT AS width FROM s"""
)
def ingested_files(spark, d):
    """A file of one of six kinds for each supplier: what becomes of it, its text, and its grid."""
    suffix = F.element_at(F.array(*[F.lit(x) for x, *_ in _KINDS.values()]), (F.col("s_suppkey") % 6 + 1).cast("int"))
    name = F.concat(F.lit("s"), F.col("s_suppkey").cast("string"), suffix)
    lines = F.array(F.struct(F.lit(0).alias("at"), F.lit("Name\tNation").alias("line")), F.struct(F.lit(1).alias("at"), F.concat_ws("\t", "s_name", "s_nationkey").alias("line")))
    folder = scratch(spark)
    sinks.write_named(_t(spark, d, "supplier").select(name.alias("name"), F.inline(lines)), folder, "\n")
    parts = written(grids.read_files(spark, folder))  # so that the files are opened once
    sizes = grids.grids(parts).groupBy(F.col("table_id").alias("name")).agg(F.count("*").alias("n_rows"), F.max(F.size("cells")).cast("long").alias("width"))
    out = grids.ingest_log(parts).join(grids.texts(parts), "name", "left").join(sizes, "name", "left")
    return out.select("name", "status", "reason", "block", F.coalesce("n_rows", F.lit(0)).alias("n_rows"), "width")


def _page_words(spark, d):
    """Positioned words of a document a customer: a title, a table of its orders with blank cells, and a closing line; five orders a page."""
    o = _t(spark, d, "orders")
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    at = o.select(F.col("o_custkey").alias("doc"), (F.floor(place / 5) + 1).alias("page"), (place % 5).alias("i"), "o_orderkey", "o_orderstatus", "o_orderpriority")

    def word(text: F.Column, x: float | F.Column, y: F.Column) -> F.Column:
        x = F.lit(x) if isinstance(x, float) else x
        return F.struct(text.alias("text"), x.alias("x0"), y.alias("top"), (x + 5.0 * F.length(text)).alias("x1"), (y + 10.0).alias("bottom"))

    y = F.col("i") * 14.0 + 60.0
    jitter = F.when(F.col("o_orderkey") % 2 == 0, 1.5).otherwise(0.0)
    key = F.col("o_orderkey").cast("string")
    row = [word(key, 40.0, y), word(F.lit("order"), F.length(key) * 5.0 + 44.0, y + jitter), F.when(F.col("o_orderkey") % 3 != 0, word(F.col("o_orderstatus"), 200.0, y + jitter)), word(F.split("o_orderpriority", "-")[0], 300.0, y)]
    words = at.select("doc", "page", F.inline(F.filter(F.array(*row), lambda w: w.isNotNull())))
    pages = at.select("doc", "page").distinct()
    title = pages.select("doc", "page", F.inline(F.array(word(F.lit("Orders"), 40.0, F.lit(20.0)), word(F.lit("of"), 73.0, F.lit(20.0)), word(F.col("doc").cast("string"), 88.0, F.lit(21.0)))))
    return words.unionByName(title).unionByName(pages.select("doc", "page", F.inline(F.array(word(F.lit("end"), 40.0, F.lit(300.0))))))


_PAGES = """
o AS (SELECT o_custkey AS doc, o_orderkey AS k, o_orderstatus AS s, string_split(o_orderpriority, '-')[1] AS p, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders),
g AS (SELECT *, (r - 1) // 5 + 1 AS page, (r - 1) % 5 AS i FROM o),
t AS (SELECT doc, page, count(*) AS n, bool_or(k % 3 <> 0) AS has_status FROM g GROUP BY ALL)"""


@query(f"""
WITH {_PAGES}
SELECT doc || '::p' || page || '_t1' AS table_id, i::BIGINT AS row_idx, k || ' order|' || CASE WHEN has_status THEN CASE WHEN k % 3 <> 0 THEN s ELSE '' END || '|' ELSE '' END || p AS line FROM g JOIN t USING (doc, page) WHERE n >= 2""")
def page_tables(spark, d):
    return layout.page_tables(layout.cells(_page_words(spark, d))).select("table_id", "row_idx", F.array_join("cells", "|").alias("line"))


@query(f"""
WITH {_PAGES}
SELECT doc, page, 'Orders of ' || doc || chr(10) || CASE WHEN n < 2 THEN any_value(k || ' order ' || CASE WHEN k % 3 <> 0 THEN s || ' ' ELSE '' END || p) || chr(10) ELSE '' END || 'end' AS text FROM g JOIN t USING (doc, page) GROUP BY doc, page, n""")
def page_texts(spark, d):
    return layout.page_texts(layout.cells(_page_words(spark, d)))
