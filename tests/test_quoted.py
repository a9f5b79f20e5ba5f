"""Quoted files cut into byte ranges, against one csv reader over the whole text."""

import csv
import io
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gristmill.sources import grid, quoted

PIECES = ["a", "word", ",", ",", '"', '""', "\n", "\n", "\r\n", "x,y\n", '"in, it"', '"two\nlines"', '"q""q"', " ", "é", '"\r\n"', 'b"c', '"d"e', "\n\n"]


def plain(text, sep=","):
    csv.field_size_limit(quoted.CELL_LIMIT)
    return list(csv.reader(io.StringIO(text, newline=""), delimiter=sep))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from([p for p in PIECES if "\n" not in p]), max_size=12), st.booleans())
def test_a_line_leaves_the_state_that_a_reader_has(parts, inside):
    line = "".join(parts)
    opened = '"open\n' if inside else ""
    rows = plain(f"{opened}{line}\nmark")
    assert quoted.after_line(line, ",", inside) == (rows[-1] != ["mark"], False)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["a", "\r", ",", '"', '"b\rc"', "d\re"]), max_size=8))
def test_bare_carriage_returns_are_told(parts):
    line = "".join(parts)
    rows = plain(line + "\n")
    open_, bare = quoted.after_line(line, ",", False)
    assert bare == (len(rows) > 1) or open_


def read(spark, folder, sep=","):
    out = {}
    for r in quoted.read_quoted(spark, [str(folder)], sep).collect():
        out.setdefault(r.file.rsplit("/", 1)[-1], []).append((r.row_idx, r.cells))
    return {name: [c for _, c in sorted(rows)] for name, rows in out.items()} if all(len({k for k, _ in v}) == len(v) for v in out.values()) else out


@pytest.fixture
def cut(spark):
    names = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"]
    before = {n: spark.conf.get(n) for n in names}

    def to(size):
        for n, v in zip(names, (size, 1)):
            spark.conf.set(n, str(v))

    yield to
    for n, v in before.items():
        spark.conf.set(n, v)


@pytest.mark.parametrize("size", [7, 31, 400])
def test_rows_are_those_of_a_reader_at_every_cut(spark, tmp_path, cut, size):
    rng = random.Random(size)
    texts = {f"f{k}.csv": "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 60))) for k in range(14)}
    texts |= {"open.csv": 'a,b\n"never\nclosed', "open_line.csv": '"never\nclosed\n', "long.csv": 'k,"' + "line\n" * 200 + '",z\nnext,row\n', "mac.csv": 'a,b\rc,"d\re"\rf\n', "none.csv": "", "crlf.csv": 'a\r\n"b\r\nc"\r\n'}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    cut(size)
    got = read(spark, tmp_path)
    want = {name: plain(text) for name, text in texts.items() if text}
    assert {n: r for n, r in got.items()} == want


def test_large_cells_bad_bytes_and_tabs(spark, tmp_path, cut):
    big = "x" * 300_000
    (tmp_path / "big.tsv").write_bytes(f'id\ttext\n1\t"{big}\n{big}"\n2\ty\n'.encode() + b"3\t\xff\xfe\n")
    cut(100_000)
    assert read(spark, tmp_path, "\t") == {"big.tsv": [["id", "text"], ["1", f"{big}\n{big}"], ["2", "y"], ["3", "��"]]}
    parts = grid.read_files(spark, str(tmp_path))
    assert sorted((r.row_idx, len(r.cells)) for r in grid.grids(parts).collect()) == [(k, 2) for k in range(4)]
    assert [tuple(r) for r in grid.ingest_log(parts).collect()] == [("big.tsv", "table", None)]


def test_names_are_taken_as_they_are(spark, tmp_path):
    for name in ("a b+c[1]%20é.CSV", "*.tsv", "{x}.csv", "note?.txt"):
        (tmp_path / name).write_text("h,g\n1,2\n")
    parts = grid.read_files(spark, str(tmp_path))
    assert sorted(r.name for r in grid.ingest_log(parts).collect()) == sorted(p.name for p in tmp_path.iterdir())
    assert {r.table_id for r in grid.grids(parts).collect()} == {"a b+c[1]%20é.CSV", "*.tsv", "{x}.csv"}
    (tmp_path / "none").mkdir()
    assert grid.read_files(spark, str(tmp_path / "none")).count() == 0


@pytest.mark.parametrize("size", [7, 400])
def test_whole_files_have_the_rows_of_their_ranges(spark, tmp_path, cut, monkeypatch, size):
    rng = random.Random(size)
    texts = {f"f{k}.{('csv', 'Tsv')[k % 2]}": "".join(rng.choice([*PIECES, "\t"]) for _ in range(rng.randint(1, 60))) for k in range(8)}
    texts |= {"mark.csv": "\ufeffh,g\n1,2\n", "mac.csv": 'a,b\rc,"d\re"\rf\n', "open.csv": 'a,b\n"never\nclosed', "n.txt": "words", "p.pdf": "x"}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode() + b"\xff" * (name == "f0.csv"))
    cut(size)
    got = []
    for most in (grid.WHOLE_BYTES, 20, 0):
        monkeypatch.setattr(grid, "WHOLE_BYTES", most)
        got.append(sorted((r.name, r.status, r.reason or "", r.text or "", r.table_id or "", -1 if r.row_idx is None else r.row_idx, r.cells or []) for r in grid.read_files(spark, str(tmp_path)).collect()))
    assert got[0] == got[1] == got[2]
    assert [r[6] for r in got[0] if r[4] == "mark.csv"] == [["h", "g"], ["1", "2"]] and {r[0] for r in got[0]} == set(texts)
