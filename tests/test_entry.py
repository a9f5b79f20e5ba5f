import os

import duckdb
import pytest

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="the driver's tables are not here")


def oracle(sql):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SMALL}/{t}.parquet')")
    got = c.sql(sql)
    return got.columns, got.fetchall()


def value(x):
    return None if x is None else f"{float(x):.9g}" if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)


def canon(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(str(value(r[i])) for i in order) for r in rows)


@pytest.mark.parametrize("name", [n for n in entry.oracle_sql() if not n.startswith("op")])
def test_query_equals_its_oracle(spark, name):
    df = entry.queries()[name](spark, SMALL)
    columns, rows = oracle(entry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(columns)
    assert canon(df.columns, [tuple(r) for r in df.collect()]) == canon(columns, rows)


def test_entry_gives_rows(spark):
    assert entry.entry(spark).count() > 0


def test_pages_are_flattened(spark):
    got = entry.queries()["html_flatten"](spark, SMALL).collect()
    assert got and all("<" not in (r.text or "")[:20] for r in got)


def test_faithfulness_reads_every_item_whole(spark, tmp_path):
    head = "a passage of more than sixty characters that all of the items begin with, "
    spark.createDataFrame([(i, f"{head}{i}.") for i in range(50)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(45, f"It says {head}45."), (46, f"It says {head}6."), (47, f"It says {head}but no more"), (95, f"So does {head}45.")]
    spark.createDataFrame([(*r, "en") for r in rows], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = entry.queries()["faithfulness_contains"](spark, str(tmp_path)).first()
    assert (got.violations, got.checked, got.matched, got.rate) == (0, 4, 2, 0.5)
