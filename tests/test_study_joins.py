"""All studies at once against one study at a time, and the numbering of a large grid."""

import random

from pyspark.sql import functions as F

from gristmill.operators import joins, study_joins
from gristmill.sources import grid

COLUMNS = {0: ["sample_id", "subject_id", "sex", "age"], 1: ["sample_id", "sex", "site"], 2: ["subject_id", "age", "note"], 3: ["study_name", "x"], 4: ["subject_id", "site", "sample_id"]}


def studies(seed):
    rng = random.Random(seed)
    rows = []
    for s in range(12):
        kinds = rng.sample(sorted(COLUMNS), rng.randint(1, 4))
        for rank, kind in enumerate(kinds):
            for i in range(rng.randint(1, 12)):
                bag = {}
                for c in COLUMNS[kind]:
                    blank = rng.random() < 0.15
                    bag[c] = "" if blank else f"{c[:2]}{rng.randrange(4)}" if c in ("sample_id", "subject_id", "study_name") else rng.choice("abc")
                rows.append((f"s{s}", f"t{kind}", rank, i, bag))
    return rows


def test_every_study_is_joined_as_it_is_alone(spark):
    rows = studies(4)
    frame = spark.createDataFrame(rows, "study string, table_id string, rank int, row_idx long, values map<string,string>").repartition(3)
    out, gate = study_joins.join_studies(frame, threshold=0.5)
    got = {(r.study, r.row_idx): ({k: v for k, v in r["values"].items()}, dict(r.conflicts)) for r in out.collect()}
    gates = {(r.study, r.table_id): r for r in gate.collect()}
    seen = 0
    for s in sorted({r[0] for r in rows}):
        tables = []
        for rank in sorted({r[2] for r in rows if r[0] == s}):
            mine = [r for r in rows if r[0] == s and r[2] == rank]
            names = list(mine[0][4])
            tables.append((mine[0][1], spark.createDataFrame([(r[3], *r[4].values()) for r in mine], ["row_idx", *names])))
        merged, log = joins.join_tables(tables, threshold=0.5)
        assert gates[s, log.anchor].is_anchor
        assert {j["right"] for j in log.joined} == {t for (st, t), r in gates.items() if st == s and r.joined}
        assert {j["right"] for j in log.skipped} == {t for (st, t), r in gates.items() if st == s and r.reason}
        for r in merged.collect():
            plain = r.asDict()
            notes = plain.pop(joins.CONFLICTS, None) or {}
            values, conflicts = got[s, plain.pop("row_idx")]
            assert {k: v for k, v in values.items() if v is not None} == {k: v for k, v in plain.items() if v is not None} and conflicts == notes
            seen += 1
    assert seen == len(got) > 40 and any(r.joined for r in gates.values())


def test_a_study_without_joins(spark):
    frame = spark.createDataFrame([("s", "t", 0, 0, {"x": "1"}), ("s", "u", 1, 0, {"y": "2"})], "study string, table_id string, rank int, row_idx long, values map<string,string>")
    out, gate = study_joins.join_studies(frame)
    assert [(r["values"], r.conflicts) for r in out.collect()] == [({"x": "1"}, {})]
    assert {(r.table_id, r.reason) for r in gate.collect()} == {("t", None), ("u", "no shared key")}
    none, _ = study_joins.join_studies(frame.where("false"))
    assert none.count() == 0


def test_one_large_grid_is_numbered_by_many_tasks(spark, monkeypatch):
    n = 40_000
    cells = F.when(F.col("id") % 5 == 3, F.array(F.lit(" "))).when(F.col("id") == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.col("id").cast("string")))
    rows = spark.range(n).select(F.lit("t").alias("table_id"), F.col("id").alias("row_idx"), cells.alias("cells"))
    monkeypatch.setattr(grid, "SPAN_ROWS", 4096)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        clean = grid.cleaned(rows)
        got = clean.select("row_idx", F.get("cells", F.lit(0)).alias("c"), F.size("cells").alias("w"), F.spark_partition_id().alias("p")).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    kept = [i for i in range(n) if i % 5 != 3]
    assert sorted((r.row_idx, r.c) for r in got) == [(k, "a" if i == 0 else str(i)) for k, i in enumerate(kept)]
    assert {r.w for r in got} == {2} and len({r.p for r in got}) > 1
    assert [(r.columns, r.n_rows) for r in grid.promote(rows).collect()] == [(["a", "b"], len(kept) - 1)]
