"""Boxes, tables and visual lines, worked by hand."""

from __future__ import annotations

import pytest
from paperloom.operators import boxes as B
from paperloom.operators import tables as T
from pyspark.sql import functions as F


def _column(spark, value, kind, of):
    return spark.createDataFrame([(value,)], f"x {kind}").select(of(F.col("x")).alias("y")).first().y


def test_distinct_boxes(spark):
    a, near, far = [0.0, 0.0, 10.0, 10.0], [3.0, 5.0, 13.0, 15.0], [4.0, 0.0, 14.0, 10.0]
    assert _column(spark, [a, near, [1.0], far, a], "array<array<double>>", B.distinct_boxes) == [a, far]
    assert _column(spark, None, "array<array<double>>", B.distinct_boxes) == []


def test_region_of_a_line(spark):
    frame = spark.createDataFrame(
        [([("text", [0.0, 0.0, 100.0, 10.0]), ("footnote", [0.0, 0.0, 98.0, 10.0])],), ([("text", [0.0, 0.0, 100.0, 10.0]), ("footnote", [0.0, 0.0, 90.0, 10.0])],), ([("table", [0.0, 0.0, 30.0, 10.0])],), ([],)],
        "regions array<struct<type:string,bbox:array<double>>>",
    )
    box = F.array(*map(F.lit, (0.0, 0.0, 100.0, 10.0)))
    assert [r[0] for r in frame.select(B.region_of(box, F.col("regions"))).collect()] == ["footnote", "text", "", ""]


def test_boxes_of_matched_words(spark):
    words = [(t, [10.0 * i, 0.0, 10.0 * i + 9, 10.0]) for i, t in enumerate("so quyet dinh ve quyet dinhh x quyet dinh".split())]
    rows = [(0, "exact", "body", "Quyết định", "f", 1, [0.0, 0.0, 60.0, 10.0]), (1, "fuzzy", "body", "quyet dinh", "f", 1, [0.0, 0.0, 200.0, 10.0]), (2, "exact", "metadata", "quyet", "f", 1, [0.0, 0.0, 60.0, 10.0]), (3, "exact", "body", "none", "f", 1, [0.0, 0.0, 60.0, 10.0]), (4, "exact", "body", "quyet", "f", 1, [0.0, 0.0, 60.0, 10.0])]
    results = spark.createDataFrame(rows, "ord int, match_kind string, chunk_type string, query string, file string, page int, box array<double>").selectExpr("*", "cast(null as array<array<double>>) match_boxes", "0 match_count", "0.5D score")
    pages = spark.createDataFrame([("f", 1, words)], "file string, page int, words array<struct<token:string,box:array<double>>>")
    found = {r.ord: (r.match_boxes, r.match_count, r.score) for r in B.hydrated(results, pages, limit=3).collect()}
    first, second, third = [10.0, 0.0, 29.0, 10.0], [40.0, 0.0, 59.0, 10.0], [70.0, 0.0, 89.0, 10.0]
    assert found == {0: ([first], 1, 1.0), 1: ([first, second, third], 3, 3.0), 2: (None, 0, 0.5), 3: (None, 0, 0.5), 4: (None, 0, 0.5)}


def test_windows_of_words_in_a_region(spark):
    words = [("b", "w2", [30.0, 0.0, 40.0, 10.0]), ("a", "w1", [0.0, 1.0, 10.0, 9.0]), (" ", "w3", [50.0, 0.0, 60.0, 10.0]), ("far", "w4", [0.0, 100.0, 10.0, 110.0])]
    frame = spark.createDataFrame([(words,)], "words array<struct<text:string,id:string,box:array<double>>>")
    inside = frame.select(B.words_in_region(F.col("words"), F.array(*map(F.lit, (0.0, 0.0, 48.0, 10.0)))).alias("w"))
    found = B.word_windows(inside, "w", 2).withColumnRenamed("windows", "c").first()
    assert [w.id for w in found.w] == ["w1", "w2", "w3"]
    assert [(c.text, c.box, c.word_ids) for c in found.c] == [("a", [0.0, 1.0, 10.0, 9.0], ["w1"]), ("a b", [0.0, 0.0, 40.0, 10.0], ["w1", "w2"]), ("b", [30.0, 0.0, 40.0, 10.0], ["w2"]), ("b", [30.0, 0.0, 60.0, 10.0], ["w2", "w3"])]


def test_visual_lines():
    word = lambda o, x0, y0, x1, y1: {"ord": o, "box": [x0, y0, x1, y1]}
    words = [word(0, 0, 0, 10, 10), word(1, 100, 1, 110, 11), word(2, 12, 2, 20, 12), word(3, 0, 20, 10, 30), word(4, 112, 0, 120, 10)]
    assert [[w["ord"] for w in line] for line in B.visual_lines(words)] == [[0, 2], [1, 4], [3]]
    assert B.visual_lines([]) == []


def _table(cells, x=(0.0, 90.0), top=0.0):
    cols = max(map(len, cells))
    boxes = [[[x[0] + c * 30.0, top + r * 10.0, x[0] + c * 30.0 + 30, top + r * 10.0 + 10] for c in range(len(row))] for r, row in enumerate(cells)]
    return {"rows": len(cells), "cols": cols, "cells": cells, "cell_boxes": boxes, "box": [x[0], top, x[1], top + 10.0 * len(cells)]}


HEAD = [["STT", "Nội dung", "Ghi chú"], ["1", "2", "3"]]
BODY = [[str(i), f"việc thứ {i} của năm. Rồi xong", "x"] for i in range(1, 4)]


def test_stacked_tables_are_split():
    whole = _table([*HEAD, *BODY, ["", "Bảng 2", ""], *HEAD, *BODY])
    first, second = T.split_stacked(whole)
    assert (first["rows"], first["box"][3]) == (5, 50.0) and (second["rows"], second["box"][1], second["cells"][0]) == (5, 60.0, HEAD[0])
    assert T.split_stacked(_table([*HEAD, *BODY])) and len(T.split_stacked(_table([*HEAD, *BODY, *BODY]))) == 1


def test_scores_of_tables():
    table = _table([*HEAD, *BODY])
    # Five rows, three columns, all cells filled, a header; no layout.
    assert T.table_score(table, []) == pytest.approx(5 * 0.18 + 3 * 0.35 + 1.2 + 1.6)
    assert T.table_score(table, [[0.0, 0.0, 90.0, 50.0]]) == pytest.approx(5 * 0.18 + 3 * 0.35 + 1.2 + 1.6 + 3.0)
    assert T.table_score(table, [[0.0, 0.0, 90.0, 10.0]]) == pytest.approx(5 * 0.18 + 3 * 0.35 + 1.2 + 1.6 - 3.0 - 2.0)
    column = _table([["a"], ["b"]])
    assert T.table_score(column, []) == pytest.approx(-12 + 2 * 0.18 + 0.35 + 1.2)
    assert T.table_score({**table, "rows": 0}, []) == -100
    assert T.set_score([], [[0.0] * 4] * 2) == -4 and T.set_score([table], [[0.0, 0.0, 90.0, 50.0], [0.0, 500.0, 90.0, 600.0]]) == pytest.approx(T.table_score(table, [[0.0, 0.0, 90.0, 50.0], [0.0, 500.0, 90.0, 600.0]]) + 1.5 - 1.2)
    loose = [["STT", "Tên", "Số"], *[["", "", "tiếp theo"]] * 3, ["1", "a", "b"], ["2", "c", "d"]]
    assert T.fragmented(loose, 3) == pytest.approx(3 / 5)


def test_text_in_cells():
    table = _table([["", "own", ""], ["", "", ""]])
    texts = [{"text": "một", "box": [2.0, 2.0, 12.0, 8.0]}, {"text": "hai", "box": [14.0, 2.0, 24.0, 8.0]}, {"text": "khác", "box": [32.0, 2.0, 50.0, 8.0]}, {"text": "ngoài", "box": [500.0, 2.0, 510.0, 8.0]}]
    cells, done, left, weak = T.filled_cells(table, texts)
    assert cells == [["một hai", "own", ""], ["", "", ""]] and (done, left, weak) == (3, 0, 0)
    assert T.filled_cells(table, texts, replace=True)[0][0][1] == "khác"
    # All of the fragment in the cell, its share of the cell, both bands, the middle inside.
    assert T.cell_match([0.0, 0.0, 10.0, 10.0], [0.0, 0.0, 20.0, 10.0], [0.0, 0.0, 90.0, 50.0]) == pytest.approx(3 + 0.5 + 0.7 + 0.75)
    assert T.cell_match([0.0, 0.0, 10.0, 10.0], [15.0, 0.0, 25.0, 10.0], [0.0, 0.0, 90.0, 50.0]) is None
    assert T.cell_match([0.0, 0.0, 10.0, 10.0], [12.0, 0.0, 22.0, 10.0], [0.0, 0.0, 90.0, 50.0]) == pytest.approx(0.12 - 1.2 * 0.05)
    assert T.text_fit(table, [f["box"] for f in texts]) == pytest.approx(6 + 6 / 120)


def test_choice_between_two_detectors():
    good, wide, column = _table([*HEAD, *BODY]), _table([["a"] * 16] * 3), _table([["a"], ["b"]])
    assert T.prefers_second([], [good], [], []) and not T.prefers_second([good], [], [], [])
    assert T.prefers_second([wide], [good], [], []) and T.prefers_second([column], [good], [], []) and not T.prefers_second([good], [wide], [], [])
    layout = [[0.0, 0.0, 90.0, 50.0]]
    assert T.prefers_second([_table([*HEAD, *BODY], top=400.0)], [good], layout, [])
    assert not T.prefers_second([good], [good], layout, [])


def test_table_operators_over_pages(spark):
    rows = [([_table([*HEAD, *BODY, ["", "Bảng 2", ""], *HEAD, *BODY])], [[0.0, 0.0, 90.0, 110.0]], [[2.0, 2.0, 12.0, 8.0]]), (None, None, None)]
    pages = spark.createDataFrame(rows, f"tables array<{T.TABLE}>, layout array<array<double>>, fragments array<array<double>>")
    first, second = T.measured(pages, "tables", "layout", "fragments").collect()
    assert len(first.scores) == len(first.fits) == 1 and len(first.parts) == 2 and second.set_score == 0.0 and second.parts == []
