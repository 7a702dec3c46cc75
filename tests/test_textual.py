"""Style of words, corrections, tokens of pages, stores and files, worked by hand."""

from __future__ import annotations

import pytest
from paperloom.operators import correction as X
from paperloom.operators import style as S
from paperloom.sources import files, store
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def test_emphasis_and_marks():
    assert S.median([]) == 0 and S.median([3, 1, 2, 10]) == 2.5
    # Medians 12, 100 and 10: larger by 1.35, higher by 2.25, dark (86 and under) and not small.
    assert S.emphasis([12.0, 13.4, 12.0, 11.9, 9.0], [100.0, 100.0, 100.0, 80.0, 80.0], [10.0, 10.0, 12.3, 10.0, 9.0]) == [0, 1, 1, 1, 0]
    assert S.style_marks([0.0, 12.0, 9.0], [-1.0, 45.0, 151.0], [0.0, 10.0, 25.0]) == [
        ["<fs_missing>", "<fsr_missing>", "<fg_missing>", "<wh_xs>", "<style_plain>"], ["<fs_m>", "<fsr_larger>", "<fg_black>", "<wh_s>", "<style_emphasis>"], ["<fs_s>", "<fsr_smaller>", "<fg_light>", "<wh_xl>", "<style_emphasis>"],
    ]  # medians 10.5, 98 and 17.5
    assert [S.bucket(x, 0.0, 255.0) for x in (-5.0, 0.0, 255.0, 300.0, 25.5 / 3)] == [0, 0, 15, 15, 0]


def test_styled_rows(spark):
    rows = [(["a", "b"], [[0.0, 0.0, 5.0, 12.0], [0.0, 0.0, 5.0, 10.0]], [12.0, 12.0], None, [1.0]), ([], [], None, None, None), (None, None, None, None, None)]
    frame = spark.createDataFrame(rows, "t array<string>, b array<array<double>>, f array<double>, g array<double>, h array<double>")
    first, second, third = (r.style for r in S.styled(frame, "t", "b", "f", "g", "h").collect())
    assert (first.fg_gray, first.word_height, first.font_size_bucket, first.fg_gray_bucket) == ([-1.0, -1.0], [12.0, 10.0], [6, 6], [0, 0]) and first.tokens[0].startswith("a<fs_m><fsr_normal><fg_missing><wh_m>")
    assert second.tokens == third.tokens == []


def test_line_buckets():
    assert S.line_buckets(["p0_l7", "p0_l3", None, "x", "P0_L7"]) == [2, 1, 0, 0, 2] and S.line_buckets(["b", "a", " ", "b"]) == [1, 2, 0, 1] and S.line_buckets(None) == []
    assert S.line_buckets([f"p0_l{i}" for i in range(24)])[10:] == [11, 12] + [13] * 4 + [14] * 4 + [15] * 4


def test_text_stats(spark):
    s = spark.createDataFrame([("Ab c: (D9)\n- x, y",), ("",), (None,)], "t string").select(S.text_stats(F.col("t")).alias("s")).collect()
    a = s[0].s
    assert (a.char_count, a.token_count, a.digit_count, a.has_colon, a.has_paren, a.has_hyphen, a.has_slash, a.has_bullet, a.newline_count, a.comma_count) == (17, 6, 1, 1, 1, 1, 0, 0, 1, 1)
    assert (a.upper_ratio, a.alpha_ratio, a.punct_ratio, a.title_ratio) == pytest.approx((2 / 17, 6 / 17, 5 / 17, 2 / 6))
    assert (s[1].s.char_count, s[1].s.digit_ratio, s[1].s.token_count, s[2].s.char_count) == (0, 0, None, 0)


def test_page_tokens():
    words = [{"id": "a", "text": "12/QĐ-A", "box": [0.0, 0.0, 70.0, 10.0], "has_space_after": False}, {"id": "b", "text": "x", "box": None, "has_space_after": None}, {"id": "c", "text": "y", "box": [0.0, 0.0, 1.0, 1.0], "has_space_after": True}]
    lines = [{"id": "l2", "order": 2, "word_ids": ["c", "gone"]}, {"id": "l1", "order": 1, "word_ids": ["a", "b"]}]
    assert [(t["id"], t["line_id"], t["word_order"], t["text"], t["start"], t["end"]) for t in S.page_tokens(3, lines, words)] == [("p3_t0", "l1", 0, "12/QĐ", 0, 5), ("p3_t1", "l1", 0, "-", 5, 6), ("p3_t2", "l1", 0, "A", 6, 7), ("p3_t3", "l1", 1, "x", 7, 8), ("p3_t4", "l2", 0, "y", 0, 1)]
    assert S.page_tokens(0, None, None) == []


TERMS = ("kế hoạch", "thực hiện", "hội nghị", "ủy ban nhân dân", "hội nghị tổng kết")


def _resources(**more):
    return X.Resources(**({"lexicon": frozenset(TERMS), "trusted": frozenset(("ủy ban nhân dân",)), "surnames": ("Nguyễn", "Trần"), "changes": {X.phrase_base(t): (t, 100, 9, 9.0) for t in TERMS}} | more))


def test_corrections_that_pass_and_that_do_not():
    r = _resources()
    fix = lambda a, b, r=r: X.aligned(a, b, r)
    assert fix("Ké  hoach nam", "Kế hoạch năm") == "Kế  hoạch nam"  # the map knows the phrase, not the year
    assert fix("kế hoạch nam", "kế hoạch năm") == "kế hoạch nam" and fix("ke hoach", "kế hoạch mới") == "ke hoach" and fix(None, "x") is None and fix("", "") == ""
    assert fix("ke hoach", "kế hoach") == "ke hoach"  # not the map's target
    assert fix("thuc hien2", "thực hiện2") == "thuc hien2" and fix("kê hoach", "bê hoạch") == "kê hoach"
    assert fix("ông Thuc Hien", "ông Thực Hiện") == "ông Thuc Hien" and fix("gặp Thuc Hien", "gặp Thực Hiện") == "gặp Thực Hiện"
    assert X.aligned("Trần Thi Ke Hoach", "Trần Thị Kế Hoạch", _resources()) == "Trần Thi Ke Hoach"  # a surname and a middle name
    assert X.aligned("ke hoach", "kế hoạch", _resources(changes={"ke hoach": ("kế hoạch", 100, 9, 3.9)})) == "ke hoach"  # not dominant
    assert X.aligned("ke hoach", "kế hoạch", _resources(ignored=frozenset(("ke hoach",)))) == "ke hoach"
    assert X.aligned("ke hoach", "kế hoạch", X.Resources()) == "kế hoạch"  # without a map accents alone count
    # A longer phrase of the lexicon, as it stands, would be lost.
    longer = _resources(lexicon=frozenset((*TERMS, "hoi nghị tổng")), trusted=frozenset())
    assert X.aligned("hoi nghị tổng", "hội nghị tổng", longer) == "hoi nghị tổng" and X.aligned("hoi nghị", "hội nghị", longer) == "hội nghị"


def test_candidates_and_persons():
    r = _resources()
    assert [(a, b, t) for a, b, t, _, _ in X.candidates("uy ban nhan dan ke hoach".split(), r)] == [(0, 4, ["ủy", "ban", "nhân", "dân"]), (4, 6, ["kế", "hoạch"])]
    assert X.allowed(["ke", "hoach"], 4.0, 1) and not X.allowed(["ke", "hoach"], 3.9, 1) and not X.allowed(["va", "hoach"], 99.0, 99) and X.allowed(["va", "ke", "hoach"], 8.0, 80) and not X.allowed(["va", "ke", "hoach"], 8.0, 79)
    assert X.persons("Đồng chí Lê Văn Tám, Bí thư".split(), r) >= {2, 3, 4} and X.persons("Chủ tịch Hồ Chí Minh".split(), r) == set() and X.persons("Ủy Ban Nhân Dân".split(), r) == set()
    assert [X.code_like(w) for w in ("A1", "III", "UB", "HĐ", "abc", "TTXVN", "a/b", "Nam")] == [True, True, True, True, False, True, True, False]


def test_accepted_rows(spark):
    lexicon = spark.createDataFrame([(t,) for t in TERMS], "term string")
    changes = spark.createDataFrame([(X.phrase_base(t), t, 100, 9, 9.0) for t in TERMS], "base string, target string, df int, tf int, dominance double")
    r = X.resources_from(lexicon, changes)
    assert X.accepted(spark.createDataFrame([("ke hoach", "kế hoạch"), (None, "x")], "a string, b string"), "a", "b", r).select("accepted").collect() == [("kế hoạch",), (None,)]


def test_store_and_files(spark, tmp_path):
    spark.range(3).write.parquet(f"file://{tmp_path}/one.parquet")
    assert list(store.connect(spark, f"file://{tmp_path}", ("one", "two"))) == ["one"] and spark.sql("SELECT count(*) AS n FROM one").first().n == 3
    assert store.schema_differences(spark.range(1), StructType.fromDDL("id bigint")) == [] and len(store.schema_differences(spark.range(1), StructType.fromDDL("id int, x string"))) == 2
    state = lambda *rows: {r.key: r.value for r in store.ensured(spark.createDataFrame([*rows], "key string, value string")).collect()}
    assert state() == store.VERSIONS | {"needs_migration": "0"} and state(("schema_version", "7"), ("needs_migration", "0"))["needs_migration"] == "1"
    table = spark.createDataFrame([(1, 'a "b", c\nd'), (2, None)], "i int, t string")
    files.write_csv(table, f"file://{tmp_path}/csv")
    assert sorted(files.read_csv(spark, f"file://{tmp_path}/csv", "i int, t string").collect()) == sorted(table.collect(), key=lambda r: r.i)
    assert any(p.read_bytes().startswith(b"\xef\xbb\xbf") for p in (tmp_path / "csv").glob("*.csv"))
    assert files.read_json_or(spark, f"file://{tmp_path}/none", "i int", spark.createDataFrame([(9,)], "i int")).first().i == 9
