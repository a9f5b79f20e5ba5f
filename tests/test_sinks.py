"""Files of exact names: their bytes, what a failed job leaves, and a rerun."""

import csv
import io

import pytest
from pyspark.sql import functions as F

from gristmill import sinks
from gristmill.sources import grid

ROWS = [("p/1".replace("/", "_"), 1, 'a "q", b', None), ("p é", 0, "two\nlines", ""), ("p é", 2, "\r", "x\ty"), ("p é", 1, " plain ", "z")]


def csv_bytes(header, rows):
    out = io.StringIO(newline="")
    csv.writer(out).writerows([header, *rows])
    return out.getvalue().encode()


def files(folder):
    return {p.name: p.read_bytes() for p in folder.iterdir() if not p.name.startswith(".")}


def test_tables_are_written_as_a_csv_writer_writes_them(spark, tmp_path):
    df = spark.createDataFrame(ROWS, "paper_id string, at long, a string, b string").repartition(3)
    papers = spark.createDataFrame([("p é",), ("p_1",), ("no rows",)], "paper_id string")
    want = {f"{p}.csv": csv_bytes(["paper_id", "a", "b"], [[r[0], r[2], r[3]] for r in sorted(ROWS) if r[0] == p]) for p in ("p é", "p_1", "no rows")}
    for _ in range(2):
        assert sinks.write_table_files(df, str(tmp_path), "at", papers=papers) == 3
        assert files(tmp_path) == want


def test_sample_files_have_a_header_each(spark, tmp_path):
    samples = spark.sql("""SELECT * FROM VALUES ('a', 0L, from_json('{"z": [1, "x"], "b": true}', 'map<string,variant>')), ('a', 1L, from_json('{"c": null}', 'map<string,variant>')), ('e', 0L, map()) AS t(paper_id, row_idx, values)""")
    sinks.write_sample_files(samples, str(tmp_path))
    assert files(tmp_path) == {"a.csv": csv_bytes(["paper_id", "b", "c", "z"], [["a", "True", "", "1; x"], ["a", "", "", ""]]), "e.csv": csv_bytes(["paper_id"], [["e"]])}


def test_json_files(spark, tmp_path):
    sinks.write_json_files(spark.createDataFrame([("a", 1)], "paper_id string, n int"), str(tmp_path))
    assert files(tmp_path)["a.json"].decode().split() == '{ "paper_id" : "a", "n" : 1 }'.split()


def test_a_failed_job_leaves_no_file(spark, tmp_path):
    (tmp_path / "x").write_text("before")
    bad = spark.range(10).select(F.concat(F.lit("f"), F.col("id").cast("string")).alias("name"), F.col("id").alias("at"), F.when(F.col("id") == 7, F.raise_error(F.lit("broken"))).otherwise("line").alias("line"))
    with pytest.raises(Exception, match="broken"):
        sinks.write_named(bad, str(tmp_path))
    with pytest.raises(ValueError, match="a/b"):
        sinks.write_named(spark.sql("SELECT 'a/b' AS name, 0 AS at, 'x' AS line"), str(tmp_path))
    assert files(tmp_path) == {"x": b"before"}


def test_lines_of_a_name_come_in_order(spark, tmp_path):
    lines = spark.range(2000).select(F.concat(F.lit("n"), (F.col("id") % 2).cast("string")).alias("name"), (-F.col("id")).alias("at"), F.col("id").cast("string").alias("line"))
    assert sinks.write_named(lines.repartition(7), str(tmp_path), "\n") == 2
    assert files(tmp_path)["n1"].decode().split() == [str(k) for k in range(1999, 0, -2)]


@pytest.fixture
def calls(monkeypatch):
    """Counts what the driver's Python asks of the JVM."""
    from py4j.clientserver import JavaClient

    made = [0]
    send = JavaClient.send_command

    def counted(self, command, *args, **kwargs):
        made[0] += command.startswith("c")  # a call; others let objects go, at any time
        return send(self, command, *args, **kwargs)

    monkeypatch.setattr(JavaClient, "send_command", counted)
    return made


def test_the_driver_does_not_work_file_by_file(spark, tmp_path, calls):
    kinds = F.element_at(F.array(*[F.lit(x) for x in (".csv", ".TSV", ".txt", ".png")]), (F.col("id") % 4 + 1).cast("int"))
    made = []
    for n in (8, 300):
        lines = spark.range(n).select(F.concat(F.lit("f"), F.col("id").cast("string"), kinds).alias("name"), F.lit(0).alias("at"), F.concat_ws("\t", F.lit("k"), "id").alias("line"))
        before = calls[0]
        assert sinks.write_named(lines, str(tmp_path / str(n)), "\n") == n
        parts = grid.read_files(spark, str(tmp_path / str(n)))
        made.append(calls[0] - before)
        assert {r.name: r.status for r in grid.ingest_log(parts).collect()} == {f"f{k}{('.csv', '.TSV', '.txt', '.png')[k % 4]}": ("table", "table", "text", "skipped")[k % 4] for k in range(n)}
        assert {r.table_id: r.cells for r in grid.grids(parts).collect()} == {f"f{k}{('.csv', '.TSV')[k % 4]}": [f"k\t{k}"] if k % 4 == 0 else ["k", str(k)] for k in range(n) if k % 4 < 2}
    assert made[0] > 0 and made[1] - made[0] < 200, made


def test_names_of_any_length_and_what_had_them(spark, tmp_path):
    tmp_path = tmp_path / "in [1] {x}%20"
    tmp_path.mkdir()
    names = ["n" * 255, "é" * 100, "old.csv", "a b%20[*].csv"]
    (tmp_path / "old.csv").write_text("before")
    (tmp_path / ".old.csv.crc").write_bytes(b"crc\0\0\0\2\0not its sum")
    lines = spark.createDataFrame([(name, at, None if at == 1 else f"{name}{at}") for name in names for at in (2, 0, 1)], "name string, at long, line string")
    assert sinks.write_named(lines, str(tmp_path), "\n") == 4
    assert files(tmp_path) == {n: f"{n}0\n\n{n}2\n".encode() for n in names}
    assert [r.value for r in spark.read.text(grid._exactly(str(tmp_path / "old.csv"))).collect()] == ["old.csv0", "", "old.csv2"]
    assert sinks.write_named(lines.where("at > 9"), str(tmp_path)) == 0
    kept = files(tmp_path)
    for bad in ("", ".", "..", "a/b", "a\0b", "n" * 256, None):
        with pytest.raises(ValueError, match="no single file"):
            sinks.write_named(lines.unionByName(spark.createDataFrame([(bad, 0, "x")], lines.schema)), str(tmp_path))
        assert files(tmp_path) == kept


def test_a_store_that_only_spark_reaches_has_the_same_files(spark, tmp_path):
    (tmp_path / "store").mkdir()
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.sinks.link./in", (tmp_path / "store").as_uri())
    lines = spark.createDataFrame([(r[0], r[1], r[2]) for r in ROWS], "name string, at long, line string")
    for folder in (str(tmp_path / "own"), "viewfs://sinks/in"):
        assert sinks.write_named(lines, folder) == 2
    assert files(tmp_path / "own") == files(tmp_path / "store") != {}
    own, store = ({(r.name, r.status, r.reason, r.row_idx, tuple(r.cells or ())) for r in grid.read_files(spark, x).collect()} for x in (str(tmp_path / "own"), "viewfs://sinks/in"))
    assert own == store != set()
