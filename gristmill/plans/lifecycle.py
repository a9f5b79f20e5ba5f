"""Queries of the lifecycle: tables to samples, stored answers to records, records to metrics, and connectors over stored pages."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..engine import Engine
from ..functions import markup, typed, values
from ..operators import evaluate, profile, records, tables
from ..sources import grid as grids
from ..sources import schema, web
from ..sources.schema import Schema
from .queries import _map, _t, query

# ---------------------------------------------------------------- small operators


@query("""
SELECT n AS nation, string_agg(seg, '; ' ORDER BY k) AS names FROM (SELECT c_nationkey AS n, c_mktsegment AS seg, min(c_custkey) AS k FROM customer GROUP BY ALL) GROUP BY n""")
def first_seen_concat(spark, d):
    c = _t(spark, d, "customer").withColumnRenamed("c_nationkey", "nation")
    return tables.joined_in_order(c, "nation", "c_mktsegment", "c_custkey")


@query("""
SELECT user_id, arg_min(value, event_id) FILTER (event_type = 'click') AS click, arg_min(value, event_id) FILTER (event_type = 'view') AS view,
       arg_min(value, event_id) FILTER (event_type = 'error') AS error FROM events GROUP BY user_id""")
def wide_first_values(spark, d):
    return tables.long_to_wide(_t(spark, d, "events"), ["user_id"], "event_type", "value", "event_id", ["click", "view", "error"])


@query("""
SELECT l_suppkey AS supplier, count(*) AS n, sum(l_linenumber)::BIGINT AS l_linenumber, sum(CASE WHEN l_returnflag = 'R' THEN 0 ELSE l_partkey END)::BIGINT AS partkey
FROM lineitem GROUP BY l_suppkey""")
def usage_totals(spark, d):
    l = _t(spark, d, "lineitem").withColumns({"supplier": F.col("l_suppkey"), "partkey": F.when(F.col("l_returnflag") != "R", F.col("l_partkey"))})
    return tables.usage(l, ["supplier"], ["l_linenumber", "partkey"])


@query("""
WITH o AS (SELECT o_custkey AS study, o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN o_custkey ELSE CASE WHEN o_custkey % 3 = 0 AND o_orderkey % 5 = 0 THEN 7 ELSE o_custkey END END AS num FROM orders)
SELECT study, min(num)::VARCHAR AS publication, count(*) AS n_samples FROM o GROUP BY study HAVING count(DISTINCT num) = 1 ORDER BY min(o_orderkey) LIMIT 20""")
def eligible_first(spark, d):
    k, o = F.col("o_custkey"), F.col("o_orderkey")
    other = F.when((k % 3 == 0) & (o % 5 == 0), " 7 ").otherwise(k.cast("string"))
    number = F.when(o % 4 == 0, F.when(o % 8 == 0, "NaN").otherwise(" ")).when(o % 4 == 1, F.concat(k.cast("string"), F.lit(".0"))).otherwise(other)
    rows = _t(spark, d, "orders").select(k.alias("study"), number.alias("pmid"), o.alias("at"))
    return tables.eligible(rows, "study", "pmid", "at", 20)


@query("""
WITH b AS (SELECT user_id, event_id % 2 AS batch, list_sort(list(DISTINCT event_type)) AS s FROM events GROUP BY ALL)
SELECT user_id AS study, count(*) AS n_batches, count(DISTINCT s) = 1 AS same FROM b GROUP BY user_id""")
def batch_subgroups(spark, d):
    e = _t(spark, d, "events").groupBy(F.col("user_id").alias("study"), (F.col("event_id") % 2).alias("batch")).agg(F.collect_list("event_type").alias("subgroups"))
    return records.same_subgroups(e)


@query("""
SELECT p_partkey AS id, p_size / CASE p_partkey % 6 WHEN 0 THEN 12 WHEN 1 THEN 365.25 WHEN 2 THEN 52 ELSE 1 END::DOUBLE AS years FROM part""")
def unit_years(spark, d):
    unit = F.element_at(F.array(F.lit(" Months"), F.lit("day"), F.lit("Weeks "), F.lit("fortnights"), F.lit(None).cast("string"), F.lit("years")), (F.col("p_partkey") % 6 + 1).cast("int"))
    return _t(spark, d, "part").select(F.col("p_partkey").alias("id"), values.to_years(F.col("p_size").cast("double"), unit).alias("years"))


# ---------------------------------------------------------------- tables to samples

_CUSTOMER = Schema.of(
    [
        {"name": "sample_id", "description": "identifier of the customer"},
        {"name": "segment", "type": "enum", "allowed_values": ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"], "description": "market segment"},
        {"name": "nation", "description": "nation of the customer"},
        {"name": "balance", "type": "number", "description": "account balance"},
    ]
)


def _grid(df: DataFrame, table: str, key: str, columns: dict[str, F.Column]) -> DataFrame:
    """A header and a row for each row of df, in the order of key."""
    head = df.sparkSession.createDataFrame([(table, -1, list(columns))], "table_id string, row_idx long, cells array<string>")
    return head.unionByName(df.select(F.lit(table).alias("table_id"), F.col(key).cast("long").alias("row_idx"), F.array(*[c.cast("string") for c in columns.values()]).alias("cells")))


def _customer_tables(spark, d) -> DataFrame:
    c = _t(spark, d, "customer")
    label = F.concat(F.lit("c"), F.col("c_custkey").cast("string"))
    own = _grid(c, "t1", "c_custkey", {"Sample ID": label, "Segment": F.col("c_mktsegment"), "Nation": F.concat(F.lit("n"), F.col("c_nationkey").cast("string"))})
    more = _grid(c.where("c_custkey % 20 <> 0"), "t2", "c_custkey", {"sample_id": label, "segment": F.when(F.col("c_custkey") % 2 == 0, "BUILDING").otherwise(F.col("c_mktsegment")), "Balance": F.col("c_acctbal")})
    e = _t(spark, d, "embeddings")
    matrix = _grid(e, "t3", "vec_id", {"name": F.concat(F.lit("v"), F.col("vec_id").cast("string")), **{f"x{i}": F.col("embedding")[i] for i in range(6)}})
    return own.unionByName(more).unionByName(matrix)


@query("""
SELECT 'c' || c_custkey AS sample_id, c_mktsegment AS segment, 'n' || c_nationkey AS nation, CASE WHEN c_custkey % 20 <> 0 THEN c_acctbal END::DOUBLE AS balance,
       CASE WHEN c_custkey % 20 <> 0 AND c_custkey % 2 = 0 AND c_mktsegment <> 'BUILDING' THEN 'BUILDING' END AS conflict FROM customer""")
def tables_to_samples(spark, d):
    from ..operators import joins

    out = Engine(spark).samples(_customer_tables(spark, d), _CUSTOMER)
    return out.rows.select("sample_id", "segment", "nation", F.col("balance").cast("double").alias("balance"), F.try_element_at(joins.CONFLICTS, F.lit("segment")).alias("conflict"))


@query("""
WITH c AS (SELECT 't3' AS table_id, unnest([embedding[1], embedding[2], embedding[3], embedding[4], embedding[5], embedding[6]])::VARCHAR AS v, vec_id FROM embeddings),
m AS (SELECT table_id, count(DISTINCT vec_id) >= 3 AND count(*) FILTER (TRY_CAST(v AS DOUBLE) IS NOT NULL) / count(*)::DOUBLE >= 0.7 AS dense FROM c GROUP BY table_id)
SELECT 't1' AS table_id, false AS is_matrix, list_sort(['nation', 'sample_id', 'segment'])::VARCHAR AS matched UNION ALL SELECT 't2', false, list_sort(['balance', 'sample_id', 'segment'])::VARCHAR
UNION ALL SELECT table_id, dense, '[]' FROM m""")
def measurement_matrix(spark, d):
    out = Engine(spark).score(_customer_tables(spark, d), _CUSTOMER)
    keys = F.array_sort(F.map_keys("matched_fields"))
    return out.select("table_id", "is_matrix", F.concat(F.lit("["), F.array_join(keys, ", "), F.lit("]")).alias("matched"))


@query("""SELECT 'c' || c_custkey AS sample_id, c_mktsegment AS segment, 'c' || c_nationkey AS nation FROM customer""")
def own_or_manifest(spark, d):
    own = _customer_tables(spark, d).where("table_id = 't3'")
    c = _t(spark, d, "customer")
    lines = _grid(c, "m", "c_custkey", {"sample_id": F.concat(F.lit("c"), F.col("c_custkey").cast("string")), "segment": F.col("c_mktsegment"), "nation": F.concat(F.lit("c"), F.col("c_nationkey").cast("string"))})
    out = Engine(spark).samples_or_manifest(own, lines, _CUSTOMER)
    return out.rows.select("sample_id", "segment", "nation")


# ---------------------------------------------------------------- answers to records and metrics


def _answers(spark, d) -> DataFrame:
    """A stored answer for each region, in two batches of fields; samples are its nations."""
    n = _t(spark, d, "nation").join(_t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    age = F.when(F.col("n_nationkey") % 3 == 0, F.concat((F.col("n_nationkey") + 20).cast("string"), F.lit(".5"))).otherwise("not reported")
    own = F.when(F.col("n_nationkey") % 4 == 0, "own").otherwise("not_reported")
    sample = F.to_json(F.create_map(F.lit("sample_id"), F.col("n_name"), F.lit("age"), age, F.lit("age_group"), F.lit("Adult"), F.lit("habitat"), own))
    grouped = n.groupBy("r_name", "r_regionkey").agg(F.array_join(F.array_sort(F.collect_list(sample)), ",").alias("samples"))
    field = '"{0}": {{"value": {1}, "extraction_type": "derived", "confidence": "high", "evidence_quote": "q"}}'

    def raw(batch: int, fields: str) -> F.Column:
        text = F.format_string('{"paper_id": "x", "granularity": "%s", "subgroups": [], "fields": {' + fields.replace("%", "%%").replace("§", "%s") + '}, "samples": [%s]}', F.lit("sample_level"), "r_regionkey", "samples")
        return F.struct(F.lit(batch).alias("batch_idx"), F.concat(F.lit("Here it is:\n```json\n"), text, F.lit("\n```")).alias("raw"))

    both = F.array(raw(0, field.format("habitat", '"zone §"')), raw(1, field.format("habitat", '"late §"') + "," + field.format("climate", '["a", "b"]')).alias("x"))
    return grouped.select(F.col("r_name").alias("paper_id"), F.inline(both))


@query("""
SELECT r_name AS study, n_name AS sample_id, CASE WHEN n_nationkey % 4 = 0 THEN 'own' ELSE 'zone ' || r_regionkey END AS habitat, 'a; b' AS climate,
       CASE WHEN n_nationkey % 3 = 0 THEN (n_nationkey + 20) || '.5' ELSE '18' END AS age_min, CASE WHEN n_nationkey % 3 = 0 THEN (n_nationkey + 20) || '.5' ELSE '65' END AS age_max
FROM nation JOIN region ON n_regionkey = r_regionkey""")
def answers_to_records(spark, d):
    samples, _ = Engine(spark).records(_answers(spark, d))
    return samples.select("study", *[typed.string(F.try_element_at("values", F.lit(c))).alias(c) for c in ("sample_id", "habitat", "climate", "age_min", "age_max")])


def _study_cells(spark, d, missing_gold: bool) -> DataFrame:
    """Customers of each nation against themselves: every third lacks its segment, every third has it blank; nation values fill what lacks."""
    c = _t(spark, d, "customer").withColumn("study", F.col("c_nationkey").cast("string"))
    key = F.col("c_custkey")
    whole = _map(sample_id=key, segment=F.col("c_mktsegment"))
    bag = F.when(key % 3 == 0, _map(sample_id=key)).when(key % 3 == 1, _map(sample_id=key, segment=F.lit(" "))).otherwise(whole)
    ours = c.where("c_custkey % 5 <> 0").select("study", key.alias("row_idx"), bag.alias("values"))
    gold = c.select("study", key.alias("row_idx"), whole.alias("values"))
    given = c.select("study").distinct().select("study", F.lit("segment").alias("field"), F.lit("building").alias("value"), F.lit("explicit").alias("extraction_type"), F.lit("low").alias("confidence"))
    fields = evaluate.field_map(["segment", "phase"], ["sample_id", "segment"])
    return evaluate.cells(ours, gold, fields, given, missing_gold_as_fn=missing_gold)


_INHERITED = """CASE WHEN c_custkey % 5 = 0 THEN 'FN' WHEN c_custkey % 3 = 1 THEN 'FN' WHEN c_custkey % 3 = 2 OR c_mktsegment = 'BUILDING' THEN 'TP_correct' ELSE 'TP_wrong' END"""


@query(f"SELECT c_nationkey::VARCHAR AS study, c_custkey AS sample_idx, {_INHERITED} AS decision FROM customer WHERE c_custkey % 5 <> 0")
def inherited_cells(spark, d):
    return _study_cells(spark, d, False).select("study", "sample_idx", "decision")


@query(f"""
WITH x AS (SELECT 'strict' AS pass, c_nationkey::VARCHAR AS study, {_INHERITED} AS decision FROM customer WHERE c_custkey % 5 <> 0 UNION ALL SELECT 'coverage', c_nationkey::VARCHAR, {_INHERITED} FROM customer),
g AS (SELECT pass, study, count(*) AS n, count(*) FILTER (decision LIKE 'TP%') AS tp, count(*) FILTER (decision = 'TP_correct') AS tp_correct, count(*) FILTER (decision = 'FN') AS fn FROM x GROUP BY ALL)
SELECT pass, study, 'segment' AS field, n, tp, fn, tp / nullif(tp + fn, 0)::DOUBLE AS recall, tp_correct / nullif(tp, 0)::DOUBLE AS value_accuracy FROM g""")
def studies_and_coverage(spark, d):
    strict, coverage = (evaluate.by_study(_study_cells(spark, d, m)).withColumn("pass", F.lit(n)) for n, m in (("strict", False), ("coverage", True)))
    return strict.unionByName(coverage).select("pass", "study", "field", "n", "tp", "fn", "recall", "value_accuracy")


@query("""
WITH f AS (SELECT doc_id, i, CASE i WHEN 0 THEN '' WHEN 1 THEN left(text, 20) ELSE text || ' not in it' END AS q, text FROM documents, unnest([0, 1, 2]) AS t(i) WHERE length(text) > 30 AND text[1:1] <> ' ')
SELECT doc_id AS study, 'f' || i AS field, CASE WHEN i = 0 THEN 'no quote' ELSE 'quote not in the text' END AS problem FROM f WHERE i <> 1""")
def quote_violations(spark, d):
    docs = _t(spark, d, "documents").where((F.length("text") > 30) & (F.substring("text", 1, 1) != " ")).select(F.col("doc_id").alias("study"), "text")
    quotes = F.array(F.lit(""), F.substring("text", 1, 20), F.concat("text", F.lit(" not in it")))
    fields = docs.select("study", F.posexplode(quotes).alias("i", "evidence_quote")).select("study", F.concat(F.lit("f"), F.col("i").cast("string")).alias("field"), F.lit("v").alias("value"), "evidence_quote")
    return evaluate.violations(fields, docs)


# ---------------------------------------------------------------- connectors over stored pages


def _asked(df: DataFrame, ask: Callable[[int], tuple], kind: str) -> DataFrame:
    """ask(id) for each id, as rows of `kind`."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([(i, *ask(i)) for i in batch["id"].tolist()], columns=[c.split()[0] for c in kind.split(", ")])

    return df.select(F.col("id").cast("long").alias("id")).mapInPandas(run, kind)


def _links(i: int):
    group = "<LinkSetDb><LinkName>{0}</LinkName><Link><Id>{1}</Id></Link></LinkSetDb>"
    pages = [group.format("pubmed_pmc_refs", i), group.format("pubmed_pmc_refs", i) + group.format("pubmed_pmc", 7 * i), "", group.format("pubmed_pmc", i)]
    tries = iter([b"<eLinkResult/>"] * (i % 7))

    def get(url: str) -> bytes:
        assert url.endswith(f"id={i}")
        return next(tries, f"<eLinkResult><LinkSet>{pages[i % 4]}</LinkSet></eLinkResult>".encode())

    return (web.pmc_of(str(i), get),)


@query("""SELECT c_custkey AS id, CASE WHEN c_custkey % 7 < 4 THEN CASE c_custkey % 4 WHEN 1 THEN 7 * c_custkey WHEN 3 THEN c_custkey END END::VARCHAR AS pmc FROM customer""")
def publication_links(spark, d):
    return _asked(_t(spark, d, "customer").select(F.col("c_custkey").alias("id")), _links, "id long, pmc string")


def _abstract(i: int):
    label = f' Label="AIM{i}"' if i % 2 else ""
    doi = f'<ArticleId IdType="doi">10.1/{i}</ArticleId>' if i % 3 else ""
    page = f"<PubmedArticleSet><PubmedArticle><Journal><Title>J{i % 5}</Title><PubDate><Year>{1990 + i % 30}</Year></PubDate></Journal><ArticleTitle> T {i} </ArticleTitle><AbstractText{label}>Some <i>text</i> {i}</AbstractText><AbstractText>End</AbstractText>{doi}</PubmedArticle></PubmedArticleSet>"
    return web.abstract_of(str(i), lambda url: page.encode())


@query(r"""
SELECT c_custkey AS id, 'TITLE: T ' || c_custkey || chr(10) || 'JOURNAL: J' || c_custkey % 5 || ' (' || (1990 + c_custkey % 30) || ')' || chr(10) || chr(10) || 'ABSTRACT:' || chr(10)
  || CASE WHEN c_custkey % 2 = 1 THEN 'AIM' || c_custkey || ': ' ELSE '' END || 'Some text ' || c_custkey || chr(10) || 'End' AS text, CASE WHEN c_custkey % 3 <> 0 THEN '10.1/' || c_custkey END AS doi FROM customer""")
def abstracts(spark, d):
    return _asked(_t(spark, d, "customer").select(F.col("c_custkey").alias("id")), _abstract, "id long, text string, doi string")


def _doi_hit(i: int):
    hits = [{"isOpenAccess": "N", "pmcid": "PMC0"}, {"inEPMC": "Y"}, *([{"inPMC": "Y", "pmcid": f"PMC{i}"}] if i % 3 else []), {"isOpenAccess": "Y", "pmcid": "PMC9"}]
    return (web.id_of_doi(f"10.1/{i}", lambda url: json.dumps({"resultList": {"result": hits if i % 5 else []}}).encode()),)


@query("SELECT s_suppkey AS id, CASE WHEN s_suppkey % 5 = 0 THEN NULL WHEN s_suppkey % 3 <> 0 THEN 'PMC' || s_suppkey ELSE 'PMC9' END AS pmc FROM supplier")
def doi_hits(spark, d):
    return _asked(_t(spark, d, "supplier").select(F.col("s_suppkey").alias("id")), _doi_hit, "id long, pmc string")


def _manifest(i: int):
    def get(url: str) -> bytes:
        if "host_body_site" in url and i % 2:
            raise web.FetchError(url)  # the archive refuses the long list
        head = " run_accession\tsample_accession\tcountry" if "host_body_site" in url else "run_accession\tsample_accession"
        rows = [f"R{i}_{k}\tS{k}" for k in range(i % 4)] if f"accession=P{i}&" in url else []
        return "\n".join([head, *rows]).encode()

    rows, warnings = web.manifest_for([f"Q{i}", f"P{i}"], get, f"P{i}" if i % 3 == 0 else None)
    return (len(rows) - 1 if rows else 0, len(rows[0]) if rows else 0, len(warnings))


@query("""
SELECT n_nationkey AS id, n_nationkey % 4 AS n_runs, CASE WHEN n_nationkey % 4 = 0 THEN 0 WHEN n_nationkey % 2 = 1 THEN 2 ELSE 3 END::BIGINT AS width,
       (CASE WHEN n_nationkey % 3 = 0 THEN 0 ELSE 1 END + CASE WHEN n_nationkey % 4 = 0 THEN 1 ELSE 0 END)::BIGINT AS n_warnings FROM nation""")
def run_manifests(spark, d):
    return _asked(_t(spark, d, "nation").select(F.col("n_nationkey").alias("id")), _manifest, "id long, n_runs long, width long, n_warnings long")


def _listing(i: int):
    prefixes = "".join(f"<CommonPrefixes><Prefix>PMC{i}.{v}/</Prefix></CommonPrefixes>" for v in range(1, i % 12 + 1))
    keys = "".join(f"<Key>PMC{i}.1/{n}</Key>" for n in ("a.XLSX", "b.csv", "B.CSV", "c.txt", "d.tsv")[: i % 6])
    return web.latest_version(prefixes.encode(), str(i)), "|".join(web.listed_tables(keys.encode()))


@query("""
SELECT c_custkey AS id, CASE WHEN c_custkey % 12 > 0 THEN 'PMC' || c_custkey || '.' || c_custkey % 12 || '/' END AS latest,
  array_to_string(list_filter([CASE WHEN c_custkey % 6 >= 1 THEN 'PMC' || c_custkey || '.1/a.XLSX' END, CASE WHEN c_custkey % 6 >= 2 THEN 'PMC' || c_custkey || '.1/b.csv' END,
    CASE WHEN c_custkey % 6 >= 5 THEN 'PMC' || c_custkey || '.1/d.tsv' END], lambda x: x IS NOT NULL), '|') AS tables FROM customer""")
def store_listings(spark, d):
    return _asked(_t(spark, d, "customer").select(F.col("c_custkey").alias("id")), _listing, "id long, latest string, tables string")


def _article(i: int):
    body = f"<body><sec><title>Methods</title><p>We used {i}.</p></sec></body>" if i % 4 else ""
    abstract = f"<abstract><p>About {i}</p></abstract>" if i % 3 else ""
    link = 'xmlns:xlink="http://www.w3.org/1999/xlink"'
    files = f'<supplementary-material {link} xlink:href="t{i}.xlsx"/><supplementary-material {link} xlink:href="T{i}.XLSX"/><supplementary-material {link} xlink:href="https://x.org/u{i}"/><supplementary-material {link} xlink:href="plain"/>'
    page = f"<r><article><front><article-title>T{i}</article-title>{abstract}</front>{body}{files}</article></r>" if i % 5 else "<r/>"
    found = markup.article(page)
    if found is None:
        return None, None, None
    return " ".join(found["text"].split()), found["has_body"], "|".join(a for _, a in markup.supplement_links(found["element"], "https://b.org/"))


@query("""
SELECT p_partkey AS id, CASE WHEN p_partkey % 5 > 0 THEN 'TITLE: T' || p_partkey || CASE WHEN p_partkey % 3 > 0 THEN ' ABSTRACT: About ' || p_partkey ELSE '' END
  || CASE WHEN p_partkey % 4 > 0 THEN ' BODY: Methods We used ' || p_partkey || '.' ELSE '' END END AS text,
  CASE WHEN p_partkey % 5 > 0 THEN p_partkey % 4 > 0 END AS has_body, CASE WHEN p_partkey % 5 > 0 THEN 'https://b.org/t' || p_partkey || '.xlsx|https://x.org/u' || p_partkey END AS links FROM part""")
def articles(spark, d):
    return _asked(_t(spark, d, "part").select(F.col("p_partkey").alias("id")), _article, "id long, text string, has_body boolean, links string")


@query("""
SELECT c_custkey % 10 AS name, arg_min(c_custkey, c_custkey % 3 * 1000000000 + c_custkey) AS id FROM customer GROUP BY c_custkey % 10""")
def first_files(spark, d):
    c = _t(spark, d, "customer")
    name = F.concat(F.when(F.col("c_custkey") % 2 == 0, "File").otherwise("FILE"), (F.col("c_custkey") % 10).cast("string"), F.lit(".csv"))
    files = c.select(name.alias("name"), F.struct((F.col("c_custkey") % 3).alias("a"), F.col("c_custkey").alias("b")).alias("priority"), F.col("c_custkey").alias("id"))
    return grids.first_by_basename(files).select(F.regexp_extract(F.lower("name"), r"([0-9]+)", 1).cast("long").alias("name"), "id")


@query("""
WITH f AS (SELECT r_regionkey, r_name, string_agg(n_name || ' (x:' || n_nationkey || ')', '|' ORDER BY n_nationkey) AS notes FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY ALL)
SELECT r_name AS schema, 'nation' AS name, 'enum' AS type, notes, r_regionkey % 2 = 0 AS required FROM f UNION ALL SELECT r_name, 'tags', 'list', '', false FROM f
UNION ALL SELECT r_name, 'size' || r_regionkey, 'number', '', true FROM f UNION ALL SELECT r_name, 'open', 'string', '', false FROM f""")
def linkml_fields(spark, d):
    """A schema for each region, whose enum has its nations, as text that is parsed."""
    n = _t(spark, d, "nation").join(_t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    value = F.concat(F.lit("      "), "n_name", F.lit(': {meaning: "x:'), F.col("n_nationkey").cast("string"), F.lit('"}'))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", value.alias("v")))), lambda x: x["v"]), "\n")
    body = """
classes: {Sample: {slots: [nation, size%d, open], attributes: {tags: {multivalued: true, range: Nation}}}}
slots: {nation: {range: Nation, required: %s}, size%d: {range: integer, required: true}, open: {range: Open}}
enums:
  Open: {reachable_from: {}}
  Nation:
    permissible_values:
%s
"""
    texts = n.groupBy("r_name", "r_regionkey").agg(listed.alias("values")).select(
        F.col("r_name").alias("schema"), F.format_string(body, "r_regionkey", F.when(F.col("r_regionkey") % 2 == 0, "true").otherwise("false"), "r_regionkey", "values").alias("text")
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, text in batch.itertuples(index=False):
                for f in schema.parse(text, "x.yaml").fields:
                    notes = "|".join(f"{v} {(f.value_descriptions or {}).get(v, '')}".strip() for v in f.allowed_values or ())
                    rows.append((name, f.name, f.type, notes, f.required))
            yield pd.DataFrame(rows, columns=["schema", "name", "type", "notes", "required"])

    return texts.mapInPandas(run, "schema string, name string, type string, notes string, required boolean")


@query("""
WITH m AS (SELECT label, vec_id, embedding, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS i FROM embeddings),
c AS (SELECT label, i, CASE WHEN (label + i) % 3 = 0 THEN 'x' || vec_id ELSE 'GCF_' || vec_id END AS first, unnest(embedding) AS v, unnest(range(len(embedding))) AS j FROM m WHERE i <= 20),
t AS (SELECT label, i, first, CASE WHEN (label + j) % 4 = 0 THEN 'low' ELSE v::VARCHAR END AS v FROM c),
s AS (SELECT label, count(DISTINCT i) FILTER (first LIKE 'GCF_%') / count(DISTINCT i)::DOUBLE AS features, count(*) FILTER (TRY_CAST(v AS DOUBLE) IS NOT NULL) / count(*)::DOUBLE AS num, count(DISTINCT i) AS n FROM t GROUP BY label)
SELECT label::VARCHAR AS table_id, n >= 2 AND features >= 0.5 AND num >= 0.7 OR label % 5 = 0 AND n >= 2 AS is_feature_matrix FROM s""")
def matrix_by_shares(spark, d):
    from pyspark.sql import Window

    e = _t(spark, d, "embeddings")
    place = F.row_number().over(Window.partitionBy("label").orderBy("vec_id"))
    m = e.withColumn("i", place)
    first = F.concat(F.when((F.col("label") + F.col("i")) % 3 == 0, "x").otherwise("GCF_"), F.col("vec_id").cast("string"))
    cells = F.transform("embedding", lambda v, j: F.when((F.col("label") + j) % 4 == 0, "low").otherwise(v.cast("string")))
    body = m.select(F.col("label").cast("string").alias("table_id"), F.col("i").cast("long").alias("row_idx"), F.concat(F.array(first), cells).alias("cells"))
    # headers of every fifth table are names of samples, those of the others are not
    names = F.transform("embedding", lambda v, j: F.concat(F.when(F.col("label") % 5 == 0, "SRR1000").otherwise("col "), j.cast("string")))
    head = m.where("i = 1").select(F.col("label").cast("string").alias("table_id"), F.lit(0).cast("long").alias("row_idx"), F.concat(F.array(F.lit("genome")), names).alias("cells"))
    return profile.feature_matrix(body.unionByName(head))
