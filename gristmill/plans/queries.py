"""The query catalogue on the driver's tables: name -> (function, oracle SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import ages, missing, narrative, strings, values
from ..functions.markup import flattened
from ..operators import accessions, evaluate, joins, mapping, profile, records, rescore, tables
from ..sources import grid as grids
from ..sources.schema import Field, Schema
from . import table_plan

CATALOGUE: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def add(run):
        CATALOGUE[run.__name__] = (run, sql)
        return run

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _map(**columns) -> F.Column:
    """A map of text values from columns."""
    return F.create_map(*[x for k, c in columns.items() for x in (F.lit(k), c.cast("string"))])


# ---------------------------------------------------------------- evaluation

FIELDS = {"name": "name", "nation": "nation", "balance": "balance", "segment": "segment"}


def _extracted(spark, d):
    c = _t(spark, d, "customer")
    segment = F.when(F.col("c_mktsegment") == "BUILDING", "NA").otherwise(F.col("c_mktsegment"))
    bag = _map(sample_id=F.col("c_custkey"), name=F.col("c_name"), nation=F.col("c_nationkey"), balance=F.col("c_acctbal"), segment=segment)
    return c.select(F.lit("all").alias("study"), F.col("c_custkey").alias("row_idx"), bag.alias("values"))


def _gold(spark, d):
    s = _t(spark, d, "supplier")
    segment = F.when(F.col("s_suppkey") % 3 == 0, "n/a").when(F.col("s_suppkey") % 3 == 1, " machinery").otherwise("Household ")
    bag = _map(sample_id=F.col("s_suppkey"), name=F.replace("s_name", F.lit("Supplier"), F.lit("customer")), nation=F.col("s_nationkey"), balance=F.col("s_acctbal"), segment=segment)
    return s.select(F.lit("all").alias("study"), F.col("s_suppkey").alias("row_idx"), bag.alias("values"))


_NUM = r"regexp_matches({0}, '^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$')"


def _num(x: str) -> str:
    return f"CASE WHEN {_NUM.format(f'trim({x})')} THEN TRY_CAST(trim({x}) AS DOUBLE) END"


def _missing(x: str) -> str:
    return f"({x} IS NULL OR lower(trim({x})) IN ('not_reported','na','n/a','','none','null'))"


def _decide(e: str, g: str) -> str:
    match = (
        f"CASE WHEN {_num(e)} IS NOT NULL AND {_num(g)} IS NOT NULL THEN CASE WHEN {_num(g)} = 0 THEN abs({_num(e)}) < 1e-9 "
        f"ELSE abs({_num(e)} - {_num(g)}) / greatest(abs({_num(g)}), 1e-9) <= 0.05 END ELSE lower(trim({e})) = lower(trim({g})) END"
    )
    return f"CASE WHEN {_missing(e)} AND {_missing(g)} THEN 'TN' WHEN {_missing(e)} THEN 'FN' WHEN {_missing(g)} THEN 'FP' WHEN {match} THEN 'TP_correct' ELSE 'TP_wrong' END"


_SIDES = """
x AS (SELECT c_custkey AS i, c_name AS name, c_nationkey::VARCHAR AS nation, c_acctbal::VARCHAR AS balance,
             CASE WHEN c_mktsegment = 'BUILDING' THEN 'NA' ELSE c_mktsegment END AS segment FROM customer),
y AS (SELECT s_suppkey AS i, replace(s_name, 'Supplier', 'customer') AS name, s_nationkey::VARCHAR AS nation, s_acctbal::VARCHAR AS balance,
             CASE s_suppkey % 3 WHEN 0 THEN 'n/a' WHEN 1 THEN ' machinery' ELSE 'Household ' END AS segment FROM supplier)"""


def _cells_sql(join: str) -> str:
    parts = " UNION ALL ".join(f"SELECT y.i, '{f}' AS field, x.{f} AS e, y.{f} AS g FROM x {join} y ON x.i = y.i" for f in FIELDS)
    return f"WITH {_SIDES}, long AS ({parts}), cell AS (SELECT i, field, {_decide('e', 'g')} AS decision FROM long)"


_COUNTED = (
    "count(*) FILTER (decision = 'TN') AS tn, count(*) FILTER (decision = 'TP_correct') AS tp_correct, "
    "count(*) FILTER (decision = 'TP_wrong') AS tp_wrong, count(*) FILTER (decision = 'FN') AS fn, count(*) FILTER (decision = 'FP') AS fp"
)


def _ratios_sql(source: str, keys: str = "") -> str:
    k = f"{keys}, " if keys else ""
    return f"""SELECT {k}tn, tp_correct, tp_wrong, fn, fp, n, tp, p AS precision, r AS recall, 2 * p * r / nullif(p + r, 0) AS f1,
      tp_correct / nullif(tp, 0)::DOUBLE AS value_accuracy, (tp_correct + tn) / nullif(n, 0)::DOUBLE AS total_accuracy FROM (
      SELECT *, tn + tp_correct + tp_wrong + fn + fp AS n, tp_correct + tp_wrong AS tp,
             (tp_correct + tp_wrong) / nullif(tp_correct + tp_wrong + fp, 0)::DOUBLE AS p,
             (tp_correct + tp_wrong) / nullif(tp_correct + tp_wrong + fn, 0)::DOUBLE AS r FROM ({source}))"""


@query(_cells_sql("JOIN") + " SELECT i AS sample_idx, field, decision FROM cell")
def cells_classify(spark, d):
    return evaluate.cells(_extracted(spark, d), _gold(spark, d), FIELDS).select("sample_idx", "field", "decision")


@query(_cells_sql("JOIN") + _ratios_sql(f"SELECT field, {_COUNTED} FROM cell GROUP BY field", "field"))
def eval_metrics_by_field(spark, d):
    cell = evaluate.cells(_extracted(spark, d), _gold(spark, d), FIELDS)
    return evaluate.metrics_by_field(cell, list(FIELDS))


@query(_cells_sql("JOIN") + _ratios_sql(f"SELECT {_COUNTED} FROM cell"))
def eval_micro(spark, d):
    return evaluate.micro(evaluate.cells(_extracted(spark, d), _gold(spark, d), FIELDS))


@query(
    f"WITH {_SIDES.replace('FROM customer', 'FROM supplier, customer WHERE c_custkey = s_suppkey').replace('FROM supplier)', 'FROM supplier)')}, "
    + "g AS (SELECT c_custkey AS i, c_mktsegment AS segment, c_nationkey::VARCHAR AS nation FROM customer), "
    + "long AS (SELECT g.i, 'segment' AS field, y.segment AS e, g.segment AS g FROM g LEFT JOIN y USING (i) UNION ALL "
    + "SELECT g.i, 'nation', y.nation, g.nation FROM g LEFT JOIN y USING (i)), "
    + f"cell AS (SELECT field, {_decide('e', 'g')} AS decision FROM long) "
    + _ratios_sql(f"SELECT field, {_COUNTED} FROM cell GROUP BY field", "field")
)
def eval_coverage_mode(spark, d):
    c = _t(spark, d, "customer")
    gold = c.select(F.lit("all").alias("study"), F.col("c_custkey").alias("row_idx"), _map(segment=F.col("c_mktsegment"), nation=F.col("c_nationkey")).alias("values"))
    cell = evaluate.cells(_gold(spark, d), gold, {"segment": "segment", "nation": "nation"}, missing_gold_as_fn=True)
    return evaluate.metrics_by_field(cell, ["segment", "nation"])


_LABELLED = f"""
long AS (SELECT d.lang, d.source, CASE WHEN d.n_chars > 500 THEN '1' WHEN d.n_chars > 100 THEN '0' ELSE 'NA' END AS e, l.quality::VARCHAR AS g
         FROM documents d JOIN labels l USING (doc_id)),
cell AS (SELECT lang, source, {_decide("e", "g")} AS decision FROM long)"""


@query(
    f"WITH {_LABELLED} "
    + _ratios_sql(
        f"SELECT 'extraction_type' AS stratum, lang AS label, {_COUNTED} FROM cell GROUP BY lang UNION ALL SELECT 'confidence', source, {_COUNTED} FROM cell GROUP BY source",
        "stratum, label",
    )
)
def eval_strata(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", "lang", "source", "n_chars").join(_t(spark, d, "labels"), "doc_id")
    guess = F.when(F.col("n_chars") > 500, "1").when(F.col("n_chars") > 100, "0").otherwise("NA")
    verdict = values.decision(guess, F.col("quality").cast("string"))
    return evaluate.strata(docs.select(verdict.alias("decision"), F.col("lang").alias("extraction_type"), F.col("source").alias("confidence")))


@query("""
WITH e AS (SELECT user_id::VARCHAR AS k, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events)
SELECT c_custkey AS row_idx, event_type AS value, c_mktsegment AS gold FROM customer JOIN e ON k = c_custkey::VARCHAR AND r = 1""")
def align_first_match(spark, d):
    ev = _t(spark, d, "events")
    e = ev.select(F.lit("all").alias("study"), F.col("event_id").alias("row_idx"), _map(acc=F.concat(F.col("user_id").cast("string"), F.lit("; other")), type=F.col("event_type")).alias("values"))
    c = _t(spark, d, "customer")
    g = c.select(F.lit("all").alias("study"), F.col("c_custkey").alias("row_idx"), _map(acc=F.concat(F.lit(" "), F.col("c_custkey").cast("string")), segment=F.col("c_mktsegment")).alias("values"))
    left, right = evaluate.align(e, g, "acc")
    both = left.select("row_idx", F.col("values")["type"].alias("value")).join(right.select("row_idx", F.col("values")["segment"].alias("gold")), "row_idx")
    return both.select("row_idx", "value", "gold")


@query("""
WITH q AS (SELECT d.doc_id, d.lang, b.text AS quote, d.text FROM documents d JOIN benchmark b ON b.item_id = d.doc_id % (SELECT count(*) FROM benchmark)),
f AS (SELECT CASE WHEN lang = 'en' THEN trim(quote) ELSE '' END AS quote, text FROM q)
SELECT count(*) FILTER (quote = '') AS violations, count(*) FILTER (quote <> '' AND text <> '') AS checked,
       count(*) FILTER (quote <> '' AND contains(lower(text), lower(quote))) AS matched,
       count(*) FILTER (quote <> '' AND contains(lower(text), lower(quote))) / nullif(count(*) FILTER (quote <> '' AND text <> ''), 0)::DOUBLE AS rate FROM f""")
def faithfulness_contains(spark, d):
    docs = _t(spark, d, "documents").select(F.col("doc_id").alias("study"), "text", "lang")
    items = _t(spark, d, "benchmark").select(F.col("item_id").alias("item"), F.col("text").alias("quote"))
    counted = items.agg(F.nullif(F.count("*"), F.lit(0)).alias("n_items"))
    fields = docs.crossJoin(F.broadcast(counted)).withColumn("item", F.col("study") % F.col("n_items")).join(items, "item")
    fields = fields.select("study", F.lit("x").alias("value"), F.when(F.col("lang") == "en", F.col("quote")).otherwise("").alias("evidence_quote"))
    return evaluate.faithfulness(fields, docs.select("study", "text"))


# ---------------------------------------------------------------- joins and unions


def _order_rows(spark, d):
    o = _t(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("row_idx"), F.col("o_orderkey").cast("string").alias("sample_id"), F.col("o_orderstatus").alias("status"))


def _line_rows(spark, d, where="true"):
    l = _t(spark, d, "lineitem").where(where)
    order = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag", "l_linestatus")
    return l.select(order.alias("row_idx"), F.col("l_orderkey").cast("string").alias("sample_id"), F.col("l_linestatus").alias("status"), F.col("l_returnflag").alias("flag"))


_FIRST_LINE = """r AS (SELECT l_orderkey, l_linestatus, l_returnflag FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey
  ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_returnflag, l_linestatus) AS k FROM lineitem) WHERE k = 1)"""


@query(f"""
WITH {_FIRST_LINE}, gate AS (SELECT count(DISTINCT o_orderkey) FILTER (o_orderkey IN (SELECT l_orderkey FROM lineitem)) / count(DISTINCT o_orderkey)::DOUBLE AS x FROM orders)
SELECT o_orderkey AS row_idx, o_orderstatus AS status, CASE WHEN x >= 0.9 THEN l_returnflag END AS flag,
       CASE WHEN x >= 0.9 AND l_linestatus <> o_orderstatus THEN l_linestatus END AS conflict
FROM orders CROSS JOIN gate LEFT JOIN r ON l_orderkey = o_orderkey""")
def join_gated_left(spark, d):
    out, _ = joins.join_tables([("orders", _order_rows(spark, d)), ("lineitem", _line_rows(spark, d))])
    return out.select("row_idx", "status", "flag", F.try_element_at(joins.CONFLICTS, F.lit("status")).alias("conflict"))


@query("""
WITH r AS (SELECT s_nationkey, s_name, s_acctbal FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS k FROM supplier) WHERE k = 1),
l AS (SELECT c_custkey, c_nationkey, CASE WHEN c_mktsegment = 'BUILDING' THEN '' ELSE c_name END AS name, c_acctbal FROM customer)
SELECT c_custkey AS row_idx, CASE WHEN s_name IS NOT NULL AND name = '' THEN s_name ELSE name END AS name,
  CASE WHEN s_name IS NULL THEN '' ELSE concat_ws(',', 'acct=' || CASE WHEN s_acctbal <> c_acctbal THEN floor(s_acctbal)::BIGINT::VARCHAR END,
    'name=' || CASE WHEN name <> '' AND name <> s_name THEN s_name END) END AS conflicts
FROM l LEFT JOIN r ON s_nationkey = c_nationkey""")
def join_conflicts(spark, d):
    c, s = _t(spark, d, "customer"), _t(spark, d, "supplier")
    name = F.when(F.col("c_mktsegment") == "BUILDING", "").otherwise(F.col("c_name"))
    left = c.select(F.col("c_custkey").alias("row_idx"), F.col("c_nationkey").cast("string").alias("k"), name.alias("name"), F.col("c_acctbal").alias("acct"))
    right = s.select(F.col("s_suppkey").alias("row_idx"), F.col("s_nationkey").cast("string").alias("k"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("acct"))
    out = joins.merge_right(left, right, "k")
    whole = F.transform_values(joins.CONFLICTS, lambda k, v: F.when(k == "acct", F.floor(v.cast("double")).cast("string")).otherwise(v))
    text = F.transform(F.array_sort(F.map_entries(whole)), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return out.select("row_idx", "name", F.array_join(text, ",").alias("conflicts"))


@query("""
WITH g AS (SELECT count(DISTINCT o_orderkey) FILTER (o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R' AND l_discount > 0.08)) AS s,
                  count(DISTINCT o_orderkey) AS n, count(*) AS rows FROM orders)
SELECT rows AS n_rows, s / n::DOUBLE AS overlap, (s / n::DOUBLE >= 0.9) AS joined FROM g""")
def join_low_overlap_skipped(spark, d):
    left, right = _order_rows(spark, d), _line_rows(spark, d, "l_returnflag = 'R' AND l_discount > 0.08")
    out, log = joins.join_tables([("orders", left), ("returns", right)])
    overlap = joins.key_overlap(left, right, "sample_id").select("overlap")
    return out.agg(F.count("*").alias("n_rows")).join(overlap.withColumn("joined", F.lit(bool(log.joined))))


@query("""
WITH p AS (SELECT 'orders-customer' AS pair, o_custkey AS a, 0 AS side FROM orders UNION ALL SELECT 'orders-customer', c_custkey, 1 FROM customer
 UNION ALL SELECT 'customer-orders', c_custkey, 0 FROM customer UNION ALL SELECT 'customer-orders', o_custkey, 1 FROM orders
 UNION ALL SELECT 'orders-lineitem', o_orderkey, 0 FROM orders UNION ALL SELECT 'orders-lineitem', l_orderkey, 1 FROM lineitem),
k AS (SELECT pair, a, min(side) AS lo, max(side) AS hi FROM p GROUP BY ALL)
SELECT pair, count(*) FILTER (lo = 0) AS n_left, count(*) FILTER (lo = 0 AND hi = 1) AS n_shared,
       count(*) FILTER (lo = 0 AND hi = 1) / count(*) FILTER (lo = 0)::DOUBLE AS overlap FROM k GROUP BY pair""")
def key_overlap_matrix(spark, d):
    o = _t(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("c"), F.col("o_orderkey").cast("string").alias("o"))
    c = _t(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("c"))
    l = _t(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("o"))
    pairs = [("orders-customer", o, c, "c"), ("customer-orders", c, o, "c"), ("orders-lineitem", o, l, "o")]
    rows = [joins.key_overlap(a, b, k).select(F.lit(name).alias("pair"), "n_left", "n_shared", "overlap") for name, a, b, k in pairs]
    return rows[0].union(rows[1]).union(rows[2])


@query("""
SELECT c_name AS name, c_nationkey::VARCHAR AS nation, c_mktsegment AS segment, '' AS site FROM customer
UNION ALL SELECT s_name, s_nationkey::VARCHAR, '', 'site ' || s_suppkey FROM supplier""")
def union_columns(spark, d):
    c = _t(spark, d, "customer").select(F.col("c_name").alias("name"), F.col("c_nationkey").cast("string").alias("nation"), F.col("c_mktsegment").alias("segment"))
    s = _t(spark, d, "supplier").select(F.col("s_name").alias("name"), F.col("s_nationkey").cast("string").alias("nation"), F.concat(F.lit("site "), F.col("s_suppkey").cast("string")).alias("site"))
    return joins.union_columns([c, s])


@query("""
SELECT o_custkey AS k, 'order' AS origin, o_orderkey AS id FROM orders
UNION ALL SELECT user_id, 'event', event_id FROM events WHERE user_id NOT IN (SELECT o_custkey FROM orders)""")
def fallback_anti(spark, d):
    own = _t(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.lit("order").alias("origin"), F.col("o_orderkey").alias("id"))
    spare = _t(spark, d, "events").select(F.col("user_id").alias("k"), F.lit("event").alias("origin"), F.col("event_id").alias("id"))
    return joins.fallback(own, spare, "k")


@query("""
SELECT r_name AS study, c_custkey AS row_idx, CASE WHEN c_mktsegment = 'BUILDING' THEN 'GENERAL' ELSE c_mktsegment END AS segment,
       CASE WHEN n_nationkey % 2 = 0 THEN 'hub of ' || n_name ELSE 'hub of ' || r_name END AS hub, (CASE WHEN c_mktsegment = 'BUILDING' THEN 2 ELSE 1 END)::BIGINT AS n_written
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def fanout_levels(spark, d):
    r, n, c = (_t(spark, d, t) for t in ("region", "nation", "customer"))
    placed = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    segment = F.when(F.col("c_mktsegment") == "BUILDING", "Not Reported").otherwise(F.col("c_mktsegment"))
    samples = placed.select(F.col("r_name").alias("study"), F.col("c_custkey").alias("row_idx"), _map(nation=F.concat(F.lower("n_name"), F.lit("s")), segment=segment).alias("values"))
    by_nation = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).groupBy(F.col("r_name").alias("study")).agg(
        F.sort_array(F.collect_list("n_name")).alias("subgroups"),
        F.map_from_entries(F.collect_list(F.struct("n_name", F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("hub of "), "n_name")).otherwise("not reported")))).alias("hubs"),
    )
    none = F.lit(None).cast("map<string,string>")
    rows = F.array(
        F.struct(F.lit("segment").alias("field"), F.lit("GENERAL").alias("value"), none.alias("by_subgroup")),
        F.struct(F.lit("hub").alias("field"), F.concat(F.lit("hub of "), "study").alias("value"), F.col("hubs").alias("by_subgroup")),
    )
    fields = by_nation.select("study", F.inline(rows))
    out = records.fan_out(samples, fields, by_nation.select("study", "subgroups"))
    return out.select("study", "row_idx", F.col("values")["segment"].alias("segment"), F.col("values")["hub"].alias("hub"), "n_written")


@query("""
WITH f AS (SELECT user_id, event_type, arg_min(value, event_id) AS value FROM events GROUP BY ALL)
SELECT c_custkey AS sample_id, event_type AS field, value FROM customer LEFT JOIN f ON user_id = c_custkey""")
def merge_batches_first_wins(spark, d):
    e = _t(spark, d, "events").select(F.col("user_id").alias("sample_id"), F.col("event_id").alias("batch"), F.col("event_type").alias("field"), "value")
    ids = _t(spark, d, "customer").select(F.col("c_custkey").alias("sample_id"))
    return records.merge_batches(e, ids).select("sample_id", "field", "value")


# ---------------------------------------------------------------- records

_AGE_SQL = """
WITH p AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'Not Reported' WHEN 1 THEN p_size::VARCHAR WHEN 2 THEN 'NA' WHEN 3 THEN p_size || '.5' END AS age,
  CASE p_partkey % 7 WHEN 0 THEN 'Adult' WHEN 1 THEN 'Infant' WHEN 2 THEN 'Newborn' WHEN 3 THEN ' Elderly ' END AS grp,
  CASE WHEN p_size > 40 THEN p_size::VARCHAR WHEN p_size > 30 THEN 'nan' END AS lo FROM part),
q AS (SELECT *, CASE WHEN lower(age) NOT IN ('not reported', 'na') THEN age::DOUBLE END AS num, CASE WHEN lo <> 'nan' THEN lo::DOUBLE END AS ln,
  CASE trim(grp) WHEN 'Adult' THEN 18 WHEN 'Infant' THEN 0 WHEN 'Elderly' THEN 65 END AS g0, CASE trim(grp) WHEN 'Adult' THEN 65 WHEN 'Infant' THEN 2 WHEN 'Elderly' THEN 130 END AS g1 FROM p),
t AS (SELECT *, CASE WHEN num = floor(num) THEN num::BIGINT::VARCHAR ELSE num::VARCHAR END AS txt FROM q)
SELECT p_partkey AS id, CASE WHEN num IS NOT NULL AND ln IS NULL THEN txt WHEN num IS NULL AND ln IS NULL AND g0 IS NOT NULL THEN g0::VARCHAR ELSE lo END AS age_min,
  CASE WHEN num IS NOT NULL THEN txt WHEN ln IS NULL AND g1 IS NOT NULL THEN g1::VARCHAR END AS age_max,
  ((CASE WHEN num IS NOT NULL AND ln IS NULL OR num IS NULL AND ln IS NULL AND g0 IS NOT NULL THEN 1 ELSE 0 END) +
   (CASE WHEN num IS NOT NULL OR ln IS NULL AND g1 IS NOT NULL THEN 1 ELSE 0 END))::BIGINT AS n_written FROM t"""


@query(_AGE_SQL)
def age_bounds(spark, d):
    p, size = _t(spark, d, "part"), F.col("p_size").cast("string")
    m5, m7 = F.col("p_partkey") % 5, F.col("p_partkey") % 7
    age = F.when(m5 == 0, "Not Reported").when(m5 == 1, size).when(m5 == 2, "NA").when(m5 == 3, F.concat(size, F.lit(".5")))
    group = F.when(m7 == 0, "Adult").when(m7 == 1, "Infant").when(m7 == 2, "Newborn").when(m7 == 3, " Elderly ")
    low = F.when(F.col("p_size") > 40, size).when(F.col("p_size") > 30, "nan")
    none = F.lit(None).cast("string")
    return p.select(F.col("p_partkey").alias("id"), ages.age_bounds(age, none, group, low, none).alias("x")).select("id", "x.*")


@query("""
SELECT user_id, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'view') AS view, count(*) FILTER (event_type = 'purchase') AS purchase,
       count(*) FILTER (event_type = 'signup') AS signup, count(*) FILTER (event_type = 'error') AS error FROM events GROUP BY user_id""")
def long_to_wide(spark, d):
    kinds = ["click", "view", "purchase", "signup", "error"]
    return _t(spark, d, "events").groupBy("user_id").pivot("event_type", kinds).agg(F.count(F.lit(1))).na.fill(0)


@query("""
SELECT r_name AS label, string_agg(DISTINCT n_name, '; ' ORDER BY n_name) AS names FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name""")
def group_concat(spark, d):
    both = _t(spark, d, "nation").join(_t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return both.groupBy(F.col("r_name").alias("label")).agg(F.array_join(F.array_sort(F.collect_set("n_name")), "; ").alias("names"))


# ---------------------------------------------------------------- grids and plans


def _part_grid(spark, d):
    p = _t(spark, d, "part")
    blank = F.when(F.col("p_size") % 3 == 0, "").otherwise(F.col("p_type"))
    blank2 = F.when(F.col("p_size") % 6 == 0, "").otherwise(F.col("p_brand"))
    cells = F.array(F.col("p_partkey").cast("string"), F.col("p_name"), blank2, blank, F.col("p_size").cast("string"))
    return p.select((F.col("p_partkey") + 1).alias("row_idx"), cells.alias("cells"))


def _part_size(spark, d):
    return _t(spark, d, "part").count() + 1, 5


_PLAN = {
    "header_rows": [0],
    "data_starts_at": 1,
    "id_columns": [{"col": 0, "name": "sample_id"}, {"col": 1, "name": "label"}],
    "melt": {
        "category_column": "kind",
        "groups": [{"value_column": "value", "sources": {"brand": 2, "type": 3}}, {"value_column": "size", "sources": {"size": 4}}],
        "skip_missing_categories": False,
    },
    "drop_rows": [3, 5],
}

_MELT_SQL = """
WITH p AS (SELECT p_partkey + 1 AS r, p_partkey::VARCHAR AS sample_id, p_name AS label, CASE WHEN p_size % 6 = 0 THEN '' ELSE p_brand END AS brand,
                  CASE WHEN p_size % 3 = 0 THEN '' ELSE p_type END AS type, p_size::VARCHAR AS size FROM part WHERE p_partkey + 1 NOT IN (3, 5))
SELECT r AS row_idx, 0 AS cat_idx, sample_id, label, 'brand' AS kind, brand AS value, '' AS size FROM p {0}
UNION ALL SELECT r, 1, sample_id, label, 'type', type, '' FROM p {1}
UNION ALL SELECT r, 2, sample_id, label, 'size', '', size FROM p"""


@query(_MELT_SQL.format("", ""))
def melt_multi_group(spark, d):
    return table_plan.execute(_part_grid(spark, d), table_plan.TablePlan.parse(_PLAN), _part_size(spark, d))


@query(_MELT_SQL.format("WHERE brand <> ''", "WHERE type <> ''"))
def melt_skip_blank(spark, d):
    plan = {**_PLAN, "melt": {**_PLAN["melt"], "skip_missing_categories": True}}
    return table_plan.execute(_part_grid(spark, d), table_plan.TablePlan.parse(plan), _part_size(spark, d))


@query("SELECT p_partkey + 1 AS row_idx, p_partkey::VARCHAR AS sample_id, CASE WHEN p_size % 3 = 0 THEN '' ELSE p_type END AS kind FROM part WHERE p_partkey + 1 NOT IN (3, 5)")
def project_by_index(spark, d):
    plan = table_plan.TablePlan((0,), 1, ((0, "sample_id"), (3, "kind")), drop_rows=(3, 5))
    return table_plan.execute(_part_grid(spark, d), plan, _part_size(spark, d))


@query(r"""
WITH l AS (SELECT doc_id, list_filter([list_transform(string_split(x, '|'), lambda c: trim(c)) FOR x IN string_split(text, chr(10))], lambda r: len(list_filter(r, lambda c: c <> '')) > 0) AS rows FROM documents),
h AS (SELECT doc_id, rows[1] AS h, len(rows) - 1 AS n_rows, list_max(list_transform(rows, lambda r: len(r))) AS width FROM l WHERE len(rows) > 1)
SELECT doc_id::VARCHAR AS table_id, n_rows, width, CASE WHEN h[1] = '' THEN 'col_0' ELSE h[1] END AS first_name, width - len(h) AS n_padded FROM h""")
def grid_promote(spark, d):
    lines = _t(spark, d, "documents").select(F.col("doc_id").cast("string").alias("table_id"), F.posexplode(F.split("text", "\n")).alias("row_idx", "line"))
    grid = lines.select("table_id", "row_idx", F.split("line", r"\|").alias("cells"))
    out = grids.promote(grid)
    names = out.select("table_id", F.get("columns", F.lit(0)).alias("first_name"), F.col("n_rows").cast("bigint").alias("n_rows"), "width")
    wide = grid.where(F.exists("cells", lambda c: F.trim(c) != "")).groupBy("table_id").agg(F.min_by(F.size("cells"), "row_idx").alias("h"))
    return names.join(wide, "table_id").select("table_id", "n_rows", "width", "first_name", (F.col("width") - F.col("h")).cast("bigint").alias("n_padded"))


# ---------------------------------------------------------------- profiles and relevance

_TOY = Schema(
    (
        Field("custkey", "customer key", "string"),
        Field("segment", "market segment of a customer", "enum", ("automobile", "building", "machinery")),
        Field("priority", "order priority", "enum", ("1-urgent", "2-high", "3-medium", "4-not specified", "5-low")),
        Field("nation", "key of the nation", "string"),
    )
)
_CUSTOMER = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]
_ORDERS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]
_SUPPLIER = ["s_suppkey", "s_name", "s_nationkey"]


def _star_cells(spark, d):
    c = profile.to_cells(_t(spark, d, "customer"), "customer", "c_custkey", _CUSTOMER)
    o = profile.to_cells(_t(spark, d, "orders"), "orders", "o_orderkey", _ORDERS)
    return c.unionByName(o).unionByName(profile.to_cells(_t(spark, d, "supplier"), "supplier", "s_suppkey", _SUPPLIER))


def _unpivot(table: str, columns: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT '{table}' AS table_id, {i} AS col_idx, '{c}' AS col, coalesce({c}::VARCHAR, '') AS value FROM {table}" for i, c in enumerate(columns))


_STAR = f"cells AS ({_unpivot('customer', _CUSTOMER)} UNION ALL {_unpivot('orders', _ORDERS)} UNION ALL {_unpivot('supplier', _SUPPLIER)})"
_PROFILE = f"""prof AS (SELECT table_id, col_idx, col, count(*) AS n_rows, count(*) FILTER (value <> '') AS n_filled, count(DISTINCT value) FILTER (value <> '') AS n_distinct,
  count(*) FILTER (value <> '' AND {_NUM.format('value')}) AS n_numeric FROM cells GROUP BY ALL)"""


@query(f"WITH {_STAR}, {_PROFILE} SELECT * FROM prof")
def column_profile(spark, d):
    return profile.column_profile(_star_cells(spark, d))


@query(f"WITH {_STAR}, {_PROFILE} SELECT table_id, sum(n_numeric) FILTER (col_idx > 0) / sum(n_filled) FILTER (col_idx > 0)::DOUBLE AS density FROM prof GROUP BY table_id")
def numeric_density(spark, d):
    return profile.numeric_density(profile.column_profile(_star_cells(spark, d)))


_ID = "id AS (SELECT table_id, max(CASE WHEN n_filled >= 4 THEN n_distinct / n_filled::DOUBLE ELSE 0 END) AS best, arg_max(col, CASE WHEN n_filled >= 4 THEN n_distinct / n_filled::DOUBLE ELSE 0 END * 1000 - col_idx / 1000.0) AS col FROM prof GROUP BY table_id)"


@query(f"WITH {_STAR}, {_PROFILE}, {_ID} SELECT table_id, CASE WHEN best > 0.9 THEN best ELSE 0 END AS id_column, CASE WHEN best > 0.9 THEN col END AS id_col FROM id")
def id_uniqueness(spark, d):
    return profile.id_signal(profile.column_profile(_star_cells(spark, d)))


_ENUM = """allowed AS (SELECT 'segment' AS field, unnest(['automobile', 'building', 'machinery']) AS v UNION ALL
  SELECT 'priority', unnest(['1-urgent', '2-high', '3-medium', '4-not specified', '5-low'])),
seen AS (SELECT DISTINCT table_id, col_idx, col, lower(value) AS v FROM cells WHERE value <> ''),
share AS (SELECT table_id, col_idx, col, f.field, avg(CASE WHEN a.v IS NULL THEN 0 ELSE 1 END) AS share FROM seen CROSS JOIN (SELECT DISTINCT field FROM allowed) f
  LEFT JOIN allowed a ON a.field = f.field AND a.v = seen.v GROUP BY ALL),
enums AS (SELECT table_id, field, col, share FROM (SELECT *, row_number() OVER (PARTITION BY table_id, field ORDER BY share DESC, col_idx) AS k FROM share) WHERE k = 1 AND share >= 0.3)"""


@query(f"WITH {_STAR}, {_ENUM} SELECT table_id, field, col, share FROM enums")
def enum_overlap(spark, d):
    return profile.enum_overlap(_star_cells(spark, d), _TOY)


@query(f"""
WITH {_STAR}, {_PROFILE}, {_ID}, {_ENUM},
base AS (SELECT table_id, max(n_rows) AS n_rows, count(*) AS n_columns, sum(n_numeric) FILTER (col_idx > 0) / sum(n_filled) FILTER (col_idx > 0)::DOUBLE AS density FROM prof GROUP BY table_id),
e AS (SELECT table_id, count(*) / 4.0::DOUBLE AS enum_match FROM enums GROUP BY table_id),
toks AS (SELECT table_id, col_idx, col, list_distinct(regexp_extract_all(lower(col), '[a-z0-9]+')) AS t FROM prof),
flds AS (SELECT * FROM (VALUES ('custkey', ['custkey'], ['custkey', 'customer', 'key']), ('segment', ['segment'], ['segment', 'market', 'of', 'a', 'customer']),
  ('priority', ['priority'], ['priority', 'order']), ('nation', ['nation'], ['nation', 'key', 'of', 'the'])) v(field, n, w)),
fit AS (SELECT table_id, field, greatest(len(list_intersect(n, t)) / len(n)::DOUBLE, CASE WHEN len(t) >= 2 THEN len(list_intersect(t, w)) / len(t)::DOUBLE ELSE 0 END) AS s FROM toks CROSS JOIN flds),
nm AS (SELECT table_id, field FROM fit GROUP BY ALL HAVING max(s) >= 0.5),
m AS (SELECT table_id, count(*) / 4.0::DOUBLE AS name_match FROM nm WHERE (table_id, field) NOT IN (SELECT table_id, field FROM enums) GROUP BY table_id),
o AS (SELECT table_id, least(n_rows / 8.0, 1.0)::DOUBLE AS shape, CASE WHEN best > 0.9 THEN best ELSE 0 END AS id_column, coalesce(name_match, 0) AS name_match, coalesce(enum_match, 0) AS enum_match
  FROM base JOIN id USING (table_id) LEFT JOIN e USING (table_id) LEFT JOIN m USING (table_id))
SELECT table_id, round(0.20 * shape + 0.20 * id_column + 0.25 * name_match + 0.35 * enum_match, 9) AS score, shape, id_column, name_match, enum_match FROM o""")
def relevance_score(spark, d):
    out = profile.relevance(_star_cells(spark, d), _TOY)
    return out.select("table_id", F.round("score", 9).alias("score"), "shape", "id_column", "name_match", "enum_match")


@query(f"""
SELECT label::VARCHAR AS table_id, count(*) >= 2 AND (label % 2 = 0) AS is_feature_matrix FROM embeddings GROUP BY label""")
def matrix_test(spark, d):
    e = _t(spark, d, "embeddings")
    order = F.row_number().over(Window.partitionBy("label").orderBy("vec_id"))
    name = F.when(F.col("label") % 2 == 0, F.concat(F.lit("GCF_"), F.col("vec_id").cast("string"))).otherwise(F.concat(F.lit("row "), F.col("vec_id").cast("string")))
    numbers = F.transform(F.slice("embedding", 1, 6), lambda x: x.cast("string"))
    body = e.select(F.col("label").cast("string").alias("table_id"), order.cast("bigint").alias("row_idx"), F.concat(F.array(name), numbers).alias("cells"))
    head = e.select(F.col("label").cast("string").alias("table_id")).distinct().select("table_id", F.lit(0).cast("bigint").alias("row_idx"), F.array(*[F.lit(x) for x in ("genome", "a", "b", "c", "d", "e", "f")]).alias("cells"))
    return profile.feature_matrix(body.unionByName(head))


@query("""
WITH p AS (SELECT *, p_partkey // 10 AS table_id, p_partkey % 10 AS col_idx, p_partkey % 6 AS how, length(p_name) AS n FROM part),
h AS (SELECT table_id, col_idx, CASE how WHEN 0 THEN upper(p_name) WHEN 1 THEN replace(p_name, ' ', '_') WHEN 2 THEN 'A-' || p_name WHEN 3 THEN p_name[1:1] || p_name[3:] WHEN 4 THEN p_name[1:1] || p_name ELSE 'no field' || p_partkey END AS header,
        CASE WHEN how < 5 THEN p_name END AS field, CASE how WHEN 0 THEN 'exact' WHEN 1 THEN 'normalized' WHEN 2 THEN 'alias' WHEN 3 THEN 'fuzzy' WHEN 4 THEN 'fuzzy' END AS tier,
        CASE WHEN how < 3 THEN 100.0 WHEN how = 3 THEN 200.0 * (n - 1) / (2 * n - 1) WHEN how = 4 THEN 200.0 * n / (2 * n + 1) END::DOUBLE AS score FROM p)
SELECT *, field IS NOT NULL AND col_idx > min(col_idx) OVER (PARTITION BY table_id, field) AS collided FROM h""")
def header_map(spark, d):
    """Headers that are names of parts, written in other ways, against all names as fields."""
    p, name = _t(spark, d, "part"), F.col("p_name")
    k, first = F.col("p_partkey"), F.substring("p_name", 1, 1)
    ways = [F.upper(name), F.replace(name, F.lit(" "), F.lit("_")), F.concat(F.lit("A-"), name), F.concat(first, F.expr("substring(p_name, 3)")), F.concat(first, name), F.concat(F.lit("no field"), k.cast("string"))]
    header = F.element_at(F.array(*ways), (k % 6 + 1).cast("int"))
    fields = [r.p_name for r in p.select("p_name").distinct().orderBy("p_name").collect()]  # a schema's worth of names
    headers = p.select(F.floor(k / 10).alias("table_id"), (k % 10).alias("col_idx"), header.alias("header"))
    return mapping.map_header_rows(headers, fields, {f"a {f}": f for f in fields})


# ---------------------------------------------------------------- text

@query("""
WITH q AS (SELECT doc_id, text, CASE doc_id % 4 WHEN 0 THEN translate(substring(text, length(text) // 3 + 1, 40), 'aeiou', 'AEIOU') WHEN 1 THEN ' ' || reverse(substring(text, 1, 60)) || 'x' WHEN 2 THEN '' ELSE right(text, 80) END AS quote FROM documents),
t AS (SELECT *, trim(quote, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') AS bare FROM q)
SELECT count(*) FILTER (coalesce(bare, '') = '') AS violations, count(*) FILTER (bare <> '' AND text <> '') AS checked, count(*) FILTER (bare <> '' AND contains(lower(text), lower(bare))) AS matched,
       count(*) FILTER (bare <> '' AND contains(lower(text), lower(bare))) / count(*) FILTER (bare <> '' AND text <> '')::DOUBLE AS rate FROM t""")
def faithfulness_quotes(spark, d):
    """Quotes of every document: of its middle with capital vowels, of its end, of its beginning reversed, and none."""
    docs = _t(spark, d, "documents").select(F.col("doc_id").alias("study"), "text")
    k, text = F.col("study") % 4, F.col("text")
    quote = F.when(k == 0, F.translate(F.substring(text, (F.floor(F.length(text) / 3) + 1).cast("int"), F.lit(40)), "aeiou", "AEIOU")).when(k == 1, F.concat(F.lit(" "), F.reverse(F.substring(text, 1, 60)), F.lit("x"))).when(k == 2, "").otherwise(F.right(text, F.lit(80)))
    fields = docs.select("study", F.lit("f").alias("field"), F.lit("v").alias("value"), quote.alias("evidence_quote"))
    return evaluate.faithfulness(fields, docs)


_MARKS = {"mail": r"[A-Za-z0-9._]+@[A-Za-z0-9]+\.[a-z]+", "license": r"\bLicense[, .]"}
_NEAR = ("licensed", "released", "version", " the ", "@")


@query(r"""
WITH p AS (SELECT * FROM (VALUES ('mail', '[A-Za-z0-9._]+@[A-Za-z0-9]+\.[a-z]+'), ('license', '\bLicense[, .]')) t(kind, re)),
s AS (SELECT doc_id, kind, text, regexp_extract_all(text, re) AS vs, regexp_split_to_array(text, re) AS gs FROM documents CROSS JOIN p),
x AS (SELECT doc_id, kind, text, vs[i] AS value,
  (list_sum(list_transform(gs[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(vs[1:i-1], lambda g: length(g))), 0))::BIGINT AS pos
  FROM s, unnest(range(1, len(vs) + 1)) AS t(i) WHERE len(vs) > 0),
w AS (SELECT doc_id, kind, value, lower(substring(text, greatest(pos - 250, 0) + 1, pos + length(value) + 250 - greatest(pos - 250, 0))) AS c FROM x)
SELECT doc_id, kind, value, max(contains(c, 'licensed')::INT + contains(c, 'released')::INT + contains(c, 'version')::INT + contains(c, ' the ')::INT + contains(c, '@')::INT)::BIGINT AS context_score, count(*) AS n
FROM w GROUP BY doc_id, kind, value""")
def accession_context(spark, d):
    return accessions.mine(_t(spark, d, "documents"), "doc_id", "text", _MARKS, _NEAR)


@query("""
WITH a AS (SELECT user_id AS doc_id, event_type AS value, CASE WHEN event_type IN ('click', 'view', 'error') THEN 'bioproject' ELSE 'run' END AS kind,
    max(CASE WHEN value > 30 THEN floor(value / 30)::BIGINT ELSE 0 END) AS s, count(*) AS n FROM events WHERE NOT (user_id % 3 = 0 AND event_type IN ('click', 'view', 'error')) GROUP BY ALL),
p AS (SELECT *, max(s) OVER (PARTITION BY doc_id) AS top, count(*) OVER (PARTITION BY doc_id) AS rivals FROM a WHERE kind = 'bioproject'),
o AS (SELECT * FROM a WHERE s > 0 AND doc_id NOT IN (SELECT doc_id FROM p))
SELECT doc_id, value AS project, CASE WHEN top > 0 THEN 1 ELSE 2 END AS rule FROM p WHERE top > 0 AND s = top OR top = 0 AND rivals = 1
UNION ALL SELECT DISTINCT doc_id, 'P-' || value, 3 FROM o""")
def resolve_projects(spark, d):
    e = _t(spark, d, "events")
    project = F.col("event_type").isin("click", "view", "error")
    rows = e.where(~((F.col("user_id") % 3 == 0) & project))
    score = F.when(F.col("value") > 30, F.floor(F.col("value") / 30)).otherwise(0)
    found = rows.groupBy(F.col("user_id").alias("doc_id"), F.col("event_type").alias("value")).agg(
        F.first(F.when(project, "bioproject").otherwise("run")).alias("kind"), F.max(score).alias("context_score"), F.count("*").alias("n")
    )
    known = e.select(F.col("event_type").alias("value"), F.concat(F.lit("P-"), "event_type").alias("project")).distinct()
    return accessions.own_projects(found, "doc_id", known)


_HEADS = ("the ", "licensed", "released", " der ", " les ", " los ")
_JUNK = r"[#$%&*]{3}"
_TAIL = r"\nTh[a-z]+\.\n"
_NARRATIVE = r"""
pieces AS (SELECT doc_id, text, source, regexp_split_to_array(text, '\nTh[a-z]+\.\n') AS ps FROM documents),
tails AS (SELECT *, CASE WHEN len(ps) > 1 THEN length(text) - length(ps[len(ps)]) - length(regexp_extract_all(text, '\nTh[a-z]+\.\n')[len(ps) - 1]) ELSE 0 END AS start FROM pieces),
bodies AS (SELECT doc_id, text, source, CASE WHEN len(ps) > 1 AND start > length(text) * 0.2 THEN left(text, start) ELSE text END AS body FROM tails),
parts AS (SELECT *, list_filter(string_split(body, chr(10)), lambda l: regexp_matches(l, '\S')) AS ls FROM bodies),
scored AS (SELECT doc_id, source, body, 2.0 * least((contains(lower(body), 'the '))::INT + contains(lower(body), 'licensed')::INT + contains(lower(body), 'released')::INT + contains(lower(body), ' der ')::INT
   + contains(lower(body), ' les ')::INT + contains(lower(body), ' los ')::INT, 6) / 6.0 + 1.5 * least(length(body), 20000) / 20000.0 + CASE WHEN source IN ('src0', 'src1') THEN 0.3 ELSE 0 END
   - 2.0 * coalesce(len(list_filter(ls, lambda l: regexp_matches(l, '[#$%&*]{3}'))) / nullif(len(ls), 0)::DOUBLE, 0) AS score FROM parts)"""


def _scored(spark, d):
    docs = _t(spark, d, "documents")
    score = narrative.narrative_score(F.col("text"), F.col("source"), _HEADS, _JUNK, _TAIL, ("src0", "src1"))
    return docs.select("doc_id", "source", score.alias("score"))


@query(f"WITH {_NARRATIVE} SELECT doc_id, round(score::DOUBLE, 9) AS score FROM scored")
def narrative_score(spark, d):
    return _scored(spark, d).select("doc_id", F.round("score", 9).alias("score"))


@query(f"WITH {_NARRATIVE} SELECT source, arg_max(doc_id, round(score::DOUBLE, 9) - doc_id / 1e15) AS doc_id FROM scored GROUP BY source")
def best_of(spark, d):
    rows = _scored(spark, d).select("doc_id", "source", F.round("score", 9).alias("score"), F.col("doc_id").alias("rung"), F.lit(True).alias("is_body"))
    return accessions.best_candidate(rows, "source").select("source", "doc_id")


@query(f"WITH {_NARRATIVE} SELECT doc_id, length(body) AS kept, md5(body) AS body FROM bodies")
def strip_tail(spark, d):
    body = narrative.strip_tail(F.col("text"), _TAIL)
    return _t(spark, d, "documents").select("doc_id", F.length(body).cast("bigint").alias("kept"), F.md5(body).alias("body"))


@query()
def html_flatten(spark, d):
    return _t(spark, d, "pages").select("page_id", flattened(F.col("html")).alias("text"))


@query("SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events")
def json_props(spark, d):
    from ..functions.jsontext import recovered_json

    wrapped = F.concat(F.lit("Here it is:\n```json\n"), "props", F.lit("\n```\ndone"))
    return _t(spark, d, "events").select("event_id", F.from_json(recovered_json(wrapped), "k long")["k"].alias("k"))


# ---------------------------------------------------------------- summaries


@query("""
WITH r AS (SELECT toxic, doc_id % 3 AS run, avg(quality) AS q, count(*) AS n FROM labels GROUP BY ALL)
SELECT toxic, median(q) AS q_median, min(q) AS q_min, max(q) AS q_max, median(n)::DOUBLE AS n_median, min(n) AS n_min, max(n) AS n_max FROM r GROUP BY toxic""")
def repeat_summary(spark, d):
    runs = _t(spark, d, "labels").groupBy("toxic", (F.col("doc_id") % 3).alias("run")).agg(F.avg("quality").alias("q"), F.count("*").alias("n"))
    return evaluate.repeats_summary(runs, "toxic", ["q", "n"])


@query("""
WITH cw AS (SELECT lower(n_name) AS label, CASE WHEN n_nationkey % 4 = 0 THEN 'R:' || r_name ELSE 'N:' || n_nationkey END AS code FROM nation JOIN region ON n_regionkey = r_regionkey),
c AS (SELECT c_custkey, ['nation_' || c_nationkey, 'nation_' || (c_custkey % 25)] AS e, ['nation_' || (c_custkey % 25)] AS g,
   CASE WHEN c_custkey % 2 = 0 THEN ['N:' || c_nationkey] ELSE [] END AS gi, c_nationkey = c_custkey % 25 AS matched FROM customer),
x AS (SELECT c_custkey, gi, matched, (SELECT list(DISTINCT code) FROM cw WHERE list_contains(e, label)) AS ec,
   (SELECT list(DISTINCT code) FROM cw WHERE list_contains(g, label)) AS gc FROM c)
SELECT count(*) AS tp, count(*) FILTER (matched) / count(*)::DOUBLE AS base, count(*) FILTER (matched OR list_has_any(ec, gc)) / count(*)::DOUBLE AS agree,
  count(*) FILTER (len(gi) > 0 AND list_has_any(ec, gi)) / nullif(count(*) FILTER (len(gi) > 0), 0)::DOUBLE AS correct, count(*) FILTER (len(gi) > 0) AS n_coded FROM x""")
def code_crosswalk_rescore(spark, d):
    n, r, c = (_t(spark, d, t) for t in ("nation", "region", "customer"))
    named = n.join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    code = F.when(F.col("n_nationkey") % 4 != 0, F.concat(F.lit("N:"), F.col("n_nationkey").cast("string"))).otherwise("")
    rows = named.select(F.col("n_name").alias("query"), F.col("r_name").alias("match"), code.alias("code"), F.col("n_nationkey").alias("order"))
    corpus = r.select(F.concat(F.lit(" "), F.upper("r_name")).alias("label"), F.concat(F.lit("R:"), "r_name").alias("code"), F.col("r_regionkey").alias("order"))
    lookup = rescore.crosswalk(rows, corpus)
    home, other = F.concat(F.lit("NATION_"), F.col("c_nationkey").cast("string")), F.concat(F.lit("nation_"), (F.col("c_custkey") % 25).cast("string"))
    gold_codes = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("N:"), F.col("c_nationkey").cast("string"))).otherwise("NA")
    cells = c.select(
        F.col("c_custkey").alias("cell_id"), F.concat_ws(" ; ", home, other).alias("extracted"), other.alias("gold"), gold_codes.alias("gold_codes"), (F.col("c_nationkey") == F.col("c_custkey") % 25).alias("matched")
    )
    return rescore.rescore(cells, lookup)


@query("SELECT DISTINCT w AS term FROM part, unnest(string_split(p_name, ' ')) AS t(w) WHERE w <> ''")
def distinct_terms(spark, d):
    joined = F.replace("p_name", F.lit(" "), F.lit(" / "))
    return _t(spark, d, "part").select(F.explode(strings.terms(joined)).alias("term")).distinct()


@query("""
SELECT o_custkey AS study, count(*) AS n_samples, min(o_orderstatus) AS status FROM orders GROUP BY o_custkey HAVING count(DISTINCT o_orderstatus) = 1 AND count(*) >= 1""")
def eligible_groups(spark, d):
    o = _t(spark, d, "orders").withColumn("id", F.concat(F.ascii("o_orderstatus").cast("string"), F.lit(".0")))
    good = o.where(~missing.no_publication(F.col("id")) & strings.whole_id(F.col("id")).isNotNull())
    out = good.groupBy(F.col("o_custkey").alias("study")).agg(F.countDistinct(strings.whole_id(F.col("id"))).alias("k"), F.count("*").alias("n_samples"), F.min("o_orderstatus").alias("status"))
    return out.where("k = 1 AND n_samples >= 1").select("study", "n_samples", "status")


@query("""
WITH p AS (SELECT * FROM (VALUES ('click', 3.0::DOUBLE, 15.0::DOUBLE), ('view', 1.0, 5.0), ('error', 15.0, 75.0)) t(model, i, o))
SELECT event_type AS model, sum(user_id)::BIGINT AS tokens_in, sum(event_id)::BIGINT AS tokens_out,
       coalesce(sum(user_id) * any_value(i) / 1000000 + sum(event_id) * any_value(o) / 1000000, 0)::DOUBLE AS usd FROM events LEFT JOIN p ON model = event_type GROUP BY event_type""")
def cost_estimate(spark, d):
    prices = spark.createDataFrame([("click", 3.0, 15.0), ("view", 1.0, 5.0), ("error", 15.0, 75.0)], "model string, i double, o double")
    used = _t(spark, d, "events").groupBy(F.col("event_type").alias("model")).agg(F.sum("user_id").alias("tokens_in"), F.sum("event_id").alias("tokens_out"))
    usd = values.cost_usd({"i": F.col("tokens_in"), "o": F.col("tokens_out")}, {"i": F.col("i"), "o": F.col("o")})
    return used.join(F.broadcast(prices), "model", "left").select("model", "tokens_in", "tokens_out", usd.alias("usd"))  # a literal of three rows


@query("""
SELECT 'p' || (c_custkey % 3) AS paper_id, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_mktsegment END AS a_segment, c_name AS sample_id, CASE WHEN c_custkey % 3 = 0 THEN c_nationkey::VARCHAR ELSE '' END AS z_nation FROM customer""")
def csv_wide_union(spark, d):
    from ..sinks import sample_rows

    c = _t(spark, d, "customer")
    third = F.col("c_custkey") % 3 == 0
    bag = F.when(third, _map(sample_id=F.col("c_name"), z_nation=F.col("c_nationkey"))).otherwise(_map(sample_id=F.col("c_name"), a_segment=F.col("c_mktsegment")))
    return sample_rows(c.select(F.concat(F.lit("p"), (F.col("c_custkey") % 3).cast("string")).alias("paper_id"), bag.alias("values")))


@query("""
SELECT r_name AS paper_id, n_name AS subgroup, 'value of ' || r_name AS region_note, CASE WHEN n_nationkey % 2 = 0 THEN 'own ' || n_name ELSE 'shared' END AS nation_note
FROM nation JOIN region ON n_regionkey = r_regionkey""")
def csv_subgroups(spark, d):
    from ..sinks import subgroup_rows

    n = _t(spark, d, "nation").join(_t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    own = F.map_from_entries(F.collect_list(F.struct("n_name", F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("own "), "n_name")).otherwise("shared"))))
    papers = n.groupBy(F.col("r_name").alias("paper_id")).agg(F.collect_list("n_name").alias("subgroups"), own.alias("m"))
    none = F.lit(None).cast("map<string,string>")
    fields = papers.select(
        "paper_id", F.inline(F.array(F.struct(F.lit("region_note").alias("field"), F.concat(F.lit("value of "), "paper_id").alias("value"), none.alias("by_subgroup")), F.struct(F.lit("nation_note").alias("field"), F.lit("shared").alias("value"), F.col("m").alias("by_subgroup")))),
    )
    return subgroup_rows(papers.select("paper_id", "subgroups"), fields, ["region_note", "nation_note"])


@query("""
SELECT user_id, count(*) AS n, sum(value) AS total FROM events GROUP BY user_id ORDER BY count(*) DESC, user_id LIMIT 20""")
def usage_and_topk(spark, d):
    used = _t(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return used.orderBy(F.desc("n"), "user_id").limit(20)


@query("SELECT DISTINCT kind, id FROM (SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'pmid' ELSE 'pmcid' END AS kind, o_custkey::VARCHAR AS id FROM orders)")
def identifier_parse(spark, d):
    o = _t(spark, d, "orders")
    text = F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit("PMID: "), F.col("o_custkey").cast("string"))).when(F.col("o_orderkey") % 2 == 0, F.col("o_custkey").cast("string"))
    raw = text.when(F.col("o_orderkey") % 4 == 1, F.concat(F.lit("pmcid:PMC"), F.col("o_custkey").cast("string"))).otherwise(F.concat(F.lit(" pmc"), F.col("o_custkey").cast("string")))
    return o.select(strings.identifier(raw).alias("x")).select("x.*").distinct()


@query("""
WITH p AS (SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_brand END AS brand FROM part)
SELECT p_partkey AS id, brand FROM p""")
def drop_missing_columns(spark, d):
    p = _t(spark, d, "part")
    brand = F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).otherwise("NA")
    wide = p.select(F.col("p_partkey").alias("id"), brand.alias("brand"), F.lit("not_reported").alias("never"), F.lit(" ").alias("blank"))
    return tables.without_missing(wide, ("id",))


@query("""
SELECT c_nationkey AS k, c_custkey AS id, CASE WHEN c_mktsegment = 'BUILDING' THEN n_name ELSE c_mktsegment END AS segment, r_name AS area
FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey""")
def precedence_join(spark, d):
    n = _t(spark, d, "nation").join(_t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    study = n.select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("segment"), F.col("r_name").alias("area"))
    segment = F.when(F.col("c_mktsegment") == "BUILDING", " NaN").otherwise(F.col("c_mktsegment"))
    samples = _t(spark, d, "customer").select(F.col("c_nationkey").alias("k"), F.col("c_custkey").alias("id"), segment.alias("segment"))
    return tables.precedence(samples, study, "k")


@query("""
WITH r AS (SELECT o_custkey, extract(month FROM o_orderdate) % 3 + 1 AS run, count(*) AS n FROM orders GROUP BY ALL),
w AS (SELECT o_custkey AS study, max(n) FILTER (run = 1) AS run1, max(n) FILTER (run = 2) AS run2, max(n) FILTER (run = 3) AS run3 FROM r GROUP BY o_custkey)
SELECT study, coalesce(run1, 0) AS run1, coalesce(run2, 0) AS run2, coalesce(run3, 0) AS run3, ((run1 IS NOT NULL)::INT + (run2 IS NOT NULL)::INT + (run3 IS NOT NULL)::INT)::BIGINT AS n_runs, coalesce(run3, run2, run1) AS last FROM w""")
def run_counts(spark, d):
    o = _t(spark, d, "orders").withColumn("run", F.month("o_orderdate") % 3 + 1)
    runs = o.groupBy(F.col("o_custkey").alias("study"), "run").agg(F.count("*").alias("n"))
    return tables.run_counts(runs, "study", "run", "n", [1, 2, 3]).na.fill(0)


@query("""
SELECT 'model ' || m AS model, k AS repeat, n_name AS study FROM nation, (VALUES ('a'), ('b')) t(m), (VALUES (1), (2), (3)) u(k)""")
def task_grid(spark, d):
    grid = tables.tasks(("model", ["model a", "model b"]), ("repeat", [1, 2, 3]))
    return _t(spark, d, "nation").select(F.inline(grid), F.col("n_name").alias("study"))


@query("""
WITH c AS (SELECT l_returnflag AS study, l_linestatus AS field, count(*) FILTER (l_discount < 0.03) AS tn, count(*) FILTER (l_discount BETWEEN 0.03 AND 0.05) AS tp_correct,
  count(*) FILTER (l_discount > 0.05 AND l_discount < 0.08) AS tp_wrong, count(*) FILTER (l_discount >= 0.08) AS fn, 0::BIGINT AS fp FROM lineitem GROUP BY ALL),
s AS (SELECT field, sum(tn)::BIGINT AS tn, sum(tp_correct)::BIGINT AS tp_correct, sum(tp_wrong)::BIGINT AS tp_wrong, sum(fn)::BIGINT AS fn, sum(fp)::BIGINT AS fp FROM c GROUP BY field),
q AS (SELECT *, (tp_correct + tp_wrong) / nullif(tp_correct + tp_wrong + fp, 0)::DOUBLE AS p, (tp_correct + tp_wrong) / nullif(tp_correct + tp_wrong + fn, 0)::DOUBLE AS r FROM s)
SELECT field, tn, tp_correct, tp_wrong, fn, fp, p, r, tp_correct / nullif(tp_correct + tp_wrong, 0)::DOUBLE AS value_accuracy, CASE WHEN p <> 0 AND r <> 0 THEN 2 * p * r / (p + r) END AS f1 FROM q""")
def field_totals(spark, d):
    x = F.col("l_discount")
    verdict = F.when(x < 0.03, "TN").when(x <= 0.05, "TP_correct").when(x < 0.08, "TP_wrong").otherwise("FN")
    cells = _t(spark, d, "lineitem").select(F.col("l_returnflag").alias("study"), F.col("l_linestatus").alias("field"), verdict.alias("decision"))
    by_study = cells.groupBy("study", "field").agg(*evaluate.counted())
    return evaluate.strict_ratios(tables.totals(by_study, ["field"], evaluate.COUNTS))


@query("SELECT sample_id, min(i) AS row_idx FROM (SELECT o_orderkey AS i, CASE WHEN o_custkey % 10 = 0 THEN NULL ELSE 'c' || o_custkey END AS sample_id FROM orders) WHERE sample_id IS NOT NULL GROUP BY sample_id")
def sample_discovery(spark, d):
    o = _t(spark, d, "orders")
    name = F.when(F.col("o_custkey") % 20 == 0, "not_reported").when(F.col("o_custkey") % 10 == 0, "").otherwise(F.concat(F.lit("c"), F.col("o_custkey").cast("string")))
    return records.sample_ids(o.select(F.col("o_orderkey").alias("row_idx"), _map(sample_id=name).alias("values")))


@query("""
SELECT doc_id, kind, n FROM (SELECT doc_id, 'top' AS kind, n, row_number() OVER (PARTITION BY source ORDER BY n DESC, doc_id) AS k FROM (SELECT doc_id, source, n_chars AS n FROM documents)) WHERE k = 1""")
def ranked_candidates(spark, d):
    rows = _t(spark, d, "documents").select("source", F.col("doc_id").alias("rung"), F.col("n_chars").alias("score"), F.lit(True).alias("is_body"))
    return accessions.best_candidate(rows, "source").select(F.col("rung").alias("doc_id"), F.lit("top").alias("kind"), F.col("score").alias("n"))


@query("""
WITH l AS (SELECT source, doc_id, n_chars, max(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM documents)
SELECT source, doc_id FROM l WHERE b IS NULL OR b < 5000""")
def ladder_replay(spark, d):
    rows = _t(spark, d, "documents").select("source", F.col("doc_id").alias("rung"), F.col("n_chars").cast("double").alias("score"), F.lit(True).alias("is_body"))
    return accessions.ladder(rows, "source", 5000.0).select("source", F.col("rung").alias("doc_id"))


@query("""
SELECT user_id::VARCHAR AS sample_id, event_type AS field, CASE WHEN count(DISTINCT value) > 1 THEN 'differs' ELSE 'agrees' END AS state FROM events
WHERE user_id < (SELECT max(c_custkey) FROM customer) + 1 GROUP BY ALL""")
def batch_agreement(spark, d):
    ids = _t(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("sample_id"))
    e = _t(spark, d, "events").select(F.col("user_id").cast("string").alias("sample_id"), F.col("event_id").alias("batch"), F.col("event_type").alias("field"), "value")
    merged = records.merge_batches(e.join(ids, "sample_id", "left_semi"), e.select("sample_id"))
    counts = e.groupBy("sample_id", "field").agg(F.countDistinct("value").alias("n"))
    return merged.where("field IS NOT NULL").join(ids, "sample_id", "left_semi").join(counts, ["sample_id", "field"]).select("sample_id", "field", F.when(F.col("n") > 1, "differs").otherwise("agrees").alias("state"))
