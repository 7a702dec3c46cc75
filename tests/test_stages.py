"""Stages of tasks, marks by rule and comparisons, worked by hand."""

from __future__ import annotations

from paperloom.operators import stages as S
from pyspark.sql import functions as F


def test_stages_fail_alone(spark):
    def run(text):
        return {"a": "A"}[text]

    tasks = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "i int, raw_text string")
    rows = {r.i: r for r in S.annotated(S.corrected(tasks, run), lambda t: t * 2).collect()}
    assert (rows[1].corrected_text, rows[1].kie_annotation, rows[1].error, rows[1].events) == ("A", "AA", None, ["correction_start", "correction_done", "kie_start", "kie_done", "file_complete"])
    assert (rows[2].corrected_text, rows[2].kie_annotation, rows[2].error, rows[2].events) == (None, None, "correction failed: 'b'", ["correction_start", "file_failed"])
    plain = {r.i: r.corrected_text for r in S.corrected(tasks, None).collect()}
    assert plain == {1: "a", 2: "b", 3: ""}


def test_rule_marks(spark):
    box = lambda x, y: [x, y, x + 20.0, y + 10.0]
    rows = [
        (1, 0, 0, "a", "MẶT TRẬN", box(10.0, 10.0)), (1, 0, 1, "b", "MẬT", box(80.0, 10.0)), (1, 0, 2, "c", "(TUYỆT  MẬT)", box(10.0, 10.0)), (1, 0, 3, "d", "TỐI MẬT", box(10.0, 20.0)), (1, 0, 4, "e", "Hỏa tốc", box(10.0, 20.0)),
        (1, 0, 5, "f", "LƯU HÀNH NỘI BỘ", box(80.0, 90.0)), (1, 1, 0, "g", "KHẨN", box(10.0, 10.0)), (2, 0, 0, "h", "MẬT", box(10.0, 10.0)), (2, 0, 1, "i", "KHẨN", box(10.0, 10.0)),
    ]
    lines = spark.createDataFrame(rows, "doc_id int, page int, ord int, id string, text string, box array<double>").withColumn("width", F.lit(100.0)).withColumn("height", F.lit(100.0))
    has = spark.createDataFrame([(2, "SECRECY_MARK")], "doc_id int, label string")
    found = sorted((r.doc_id, r.field_id, r.label, r.line_id, r.text) for r in S.rule_marks(lines, has).collect())
    assert found == [(1, "rb_1", "SECRECY_MARK", "c", "(TUYỆT  MẬT)"), (1, "rb_2", "CIRCULATION_MARK", "f", "LƯU HÀNH NỘI BỘ"), (2, "rb_1", "URGENCY_MARK", "i", "KHẨN")]


def test_comparisons(spark):
    table = "array<struct<rows:int,cols:int,text:string>>"
    frame = spark.createDataFrame([(1, [(2, 2, "ab cd"), (3, 1, "x")], [(2, 4, "ab  cd ")]), (2, [], []), (3, [(1, 1, "")], [(1, 1, "")])], f"doc_id int, g {table}, f {table}")
    rows = {r.doc_id: (r.gold_count, r["count"], r.shape_accuracy, r.text_accuracy) for r in S.compared_tables(frame, "g", "f").collect()}
    assert rows == {1: (2, 1, 0.25, 0.5), 2: (0, 0, 1.0, 1.0), 3: (1, 1, 1.0, 1.0)}
    sides = spark.createDataFrame([(0.9, 0.9), (0.9, 0.88), (0.9, 0.8), (0.5, 0.9)], "o double, t double").select(S.verdict(F.col("o"), F.col("t"))).collect()
    assert [r[0] for r in sides] == ["praise", "tie", "warn", "praise"]
