"""Order-dependent operators on small cases."""

from __future__ import annotations

from paperloom.functions import fuzzy
from paperloom.operators import greedy


def _boxes(spark, rows):
    return spark.createDataFrame([(1, i, float(s), *map(float, b)) for i, (s, b) in enumerate(rows)], "g long, k long, score double, x0 double, y0 double, x1 double, y1 double")


def test_suppression(spark):
    boxes = _boxes(spark, [(0.9, (0, 0, 10, 10)), (0.8, (1, 0, 10, 10)), (0.7, (20, 0, 30, 10)), (0.9, (0, 0, 10, 10))])
    assert sorted(r.k for r in greedy.suppressed(boxes, "g", "k", "score", 0.5).collect()) == [0, 2]


def test_matching_takes_each_once(spark):
    pairs = spark.createDataFrame([(1, 0, 5, 2.0), (1, 0, 6, 2.0), (1, 1, 5, 9.0), (1, 2, 7, 0.0)], "g long, a long, b long, w double")
    assert sorted((r.a, r.b) for r in greedy.matched(pairs, "g", "a", "b", "w").collect()) == [(0, 5)]


def test_chunks(spark):
    sizes = [29, 30, 100, 250, 251, 10, 5]
    lines = spark.createDataFrame([(1, i, 0 if i < 6 else 1, " ".join(["w"] * n)) for i, n in enumerate(sizes)], "doc_id long, pos int, page int, line string")
    found = [(r.first, r.last, r.words) for r in greedy.chunked(lines).orderBy("chunk").collect()]
    assert found == [(0, 2, 159), (3, 3, 250), (4, 4, 251), (5, 5, 10), (6, 6, 5)]


def test_reading_orders(spark):
    boxes = _boxes(spark, [(1, (50, 0, 90, 10)), (1, (0, 1, 40, 11)), (1, (0, 30, 90, 40)), (1, (60, 60, 90, 70)), (1, (0, 60, 40, 90))])
    assert [r.k for r in greedy.reading_order(boxes, "g", "k").orderBy("rank").collect()] == [1, 0, 2, 4, 3]
    assert [r.k for r in greedy.xy_cut(boxes, "g", "k").orderBy("rank").collect()] == [1, 0, 2, 4, 3]


def test_detections(spark):
    gold = spark.createDataFrame([(1, 0, 0.0, 0.0, 10.0, 10.0), (1, 1, 50.0, 0.0, 60.0, 10.0)], "g long, ord int, x0 double, y0 double, x1 double, y1 double")
    found = spark.createDataFrame([(1, 0, 0.0, 0.0, 10.0, 9.0), (1, 1, 0.0, 0.0, 10.0, 10.0), (2, 0, 0.0, 0.0, 1.0, 1.0)], gold.schema)
    rows = {r.g: (r.tp, r.fp, r.fn, r.mean_iou) for r in greedy.detections(gold, found, "g").collect()}
    assert rows == {1: (1, 1, 1, 1.0), 2: (0, 1, 0, 0.0)}


def test_fuzzy_tokens():
    assert fuzzy.damerau("ca", "abc") == 2 and fuzzy.damerau("ab", "ba") == 1 and fuzzy.damerau("", "abc") == 3
    assert fuzzy.token_match("quyet", "quyte") and not fuzzy.token_match("2024", "1024") and fuzzy.token_match("20245", "20246") and not fuzzy.token_match("a1", "a2")
    assert fuzzy.frequency("x x x", "x x") == 0 and fuzzy.frequency("Đảng ủy xã", "dang uy") == 2
    assert fuzzy.frequency(" ".join("abcdefgh"), " ".join(f"t{i}" for i in range(8))) == 0
