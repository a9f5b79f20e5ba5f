"""Tables and text of positioned words."""

from gristmill.sources import layout


def place(spark, rows):
    """rows of (page, y, [(x, text), ...]) as words of document d, five points a letter."""
    words = [("d", p, t, float(x), float(y), x + 5.0 * len(t), y + 10.0) for p, y, line in rows for x, t in line]
    return layout.cells(spark.createDataFrame(words, "doc string, page int, text string, x0 double, top double, x1 double, bottom double").repartition(3))


def test_columns_follow_the_spans_of_cells(spark):
    found = place(spark, [
        (1, 10, [(10, "A"), (18, "title")]), (1, 30, [(10, "name"), (100, "age"), (200, "place")]), (1, 42, [(12, "ann"), (31, "lee"), (205, "rome")]), (1, 54, [(10, "bo"), (104, "7")]), (1, 80, [(10, "the"), (30, "end")]),
        (2, 10, [(10, "alone"), (100, "row")]), (2, 40, [(10, "x")]), (3, 10, [(10, "a"), (60, "b")]), (3, 24, [(10, "c"), (60, "d")]), (3, 40, [(10, "between")]), (3, 60, [(10, "e"), (90, "f")]), (3, 74, [(11, "g"), (91, "h")]),
    ])
    got = {}
    for r in layout.page_tables(found).collect():
        got.setdefault(r.table_id, {})[r.row_idx] = r.cells
    assert got == {
        "d::p1_t1": {0: ["name", "age", "place"], 1: ["ann lee", "", "rome"], 2: ["bo", "7", ""]},
        "d::p3_t1": {0: ["a", "b"], 1: ["c", "d"]}, "d::p3_t2": {0: ["e", "f"], 1: ["g", "h"]},
    }
    assert {r.page: r.text for r in layout.page_texts(found).collect()} == {1: "A title\nthe end", 2: "alone row\nx", 3: "between"}


def test_lines_are_told_by_gaps_and_empty_pages_are_none(spark):
    found = place(spark, [(1, 10, [(60, "b")]), (1, 12, [(10, "a")]), (1, 14.5, [(110, "c")]), (1, 18, [(10, "d")])])
    assert sorted((r.line, r.cell, r.text) for r in found.collect()) == [(0, 0, "a"), (0, 1, "b"), (0, 2, "c"), (1, 0, "d")]
    assert layout.page_tables(found).count() == 0 and layout.page_texts(found.where("false")).count() == 0
