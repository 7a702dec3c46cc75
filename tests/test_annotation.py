"""Pages to read, kept fields, scores and repairs of instances, worked by hand."""

from __future__ import annotations

import time

import pyarrow as pa
import pytest
from paperloom.functions import repair, values
from paperloom.operators import annotation as A
from paperloom.operators import boxes as B
from paperloom.operators import candidates as C
from paperloom.plans import annotations
from paperloom.plans.pagequeries import PLANTED
from pyspark.sql import functions as F

PAGES = [
    (1, 0, "Một", "Một"), (2, 0, "x", "a"), (2, 1, "y", "b"), (2, 2, "Phụ lục 1", "Phụ lục 1 Nơi nhận"),
    (3, 0, "đầu", "TM. ỦY BAN"), (3, 1, "x", "Nơi nhận: ... CHỦ TỊCH"), (3, 2, "x", "KT. CHỦ TỊCH"), (3, 3, "PHỤ LỤC", "T/M Nơi nhận Chủ tịch"), (3, 4, "x", "hết"),
    (4, 0, "x", "x"), (4, 1, "x", "thư ký Nguyễn Văn An"), (4, 2, "x", "x"), (4, 3, "x", "x"), (5, 0, "a", "a"), (5, 1, "a", "a"), (5, 2, "a", "a"), (5, 3, "Phụ lục", "a"),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(PAGES, "doc_id long, page int, first_line string, text string")


def test_page_candidates(pages):
    found = {(r.doc_id, r.page): (r.score, r.appendix) for r in A.page_candidates(pages).collect()}
    # chu tich 2; kt. and chu tich 5 + 2; t/m, noi nhan, chu tich less the appendix, and one of the last two.
    assert found[3, 1] == (3 + 2, False) and found[3, 2] == (7, False) and found[3, 3] == (5 + 3 + 2 + 1 - 4, True) and found[3, 4] == (0, False)
    assert found[2, 2] == (3 + 1 - 4, True) and found[4, 1] == (2, False)


def test_page_selection(pages):
    found = {r.doc_id: (r.selected, r.primary, r.signature, r.strategy, r.confidence, r.needs_review) for r in A.page_selection(pages).collect()}
    assert found[1] == ([0], 0, None, "single_page_document", "high", False)
    assert found[2] == ([0, 1, 2], 0, 1, "all_pages_small_document", "high", False)
    assert found[3] == ([0, 2, 4], 0, 2, "first_last_plus_keyword_match", "high", False)
    assert found[4] == ([0, 1, 3], 0, 1, "first_last_plus_keyword_match", "medium", True)
    assert found[5] == ([0, 2], 0, 2, "first_last_non_appendix", "medium", False)


def test_boosted_selection(spark, pages):
    selection = A.page_selection(pages)
    signers = spark.createDataFrame([(3, "An"), (4, "Lê Văn An")], "doc_id long, signer string")
    found = {r.doc_id: (r.confidence, r.needs_review, r.match) for r in A.boosted_selection(selection, signers, pages).collect()}
    assert found[4] == ("high", False, "partial") and found[3] == ("high", False, None) and found[5] == ("medium", False, None)
    match = lambda n, t: spark.range(1).select(A.signer_match(F.lit(n), F.lit(t)).alias("m")).first().m
    assert [match("Nguyễn Văn An", "ký: NGUYEN  VAN AN"), match("Trần An", "x"), match("Lê Hoàng", "ông hoang"), match("Le An", "an"), match("", "x")] == ["exact", None, "partial", None, None]


def test_primary_page_fields(spark):
    rows = spark.createDataFrame([(1, 0, "DOC_SUBJECT"), (1, 2, "DOC_SUBJECT"), (1, 2, "SIGNER_NAME"), (2, 1, "DOC_SUBJECT"), (3, 0, "ADDRESSEE")], "doc_id long, page int, label string")
    assert sorted(tuple(r) for r in A.primary_page_fields(rows).collect()) == [(1, 0, "DOC_SUBJECT"), (1, 2, "SIGNER_NAME"), (2, 1, "DOC_SUBJECT"), (3, 0, "ADDRESSEE")]


def test_instance_score(spark):
    rows = [
        ("DOC_NUMBER_SYMBOL", "Số: 12/QĐ", 2, 1, 0.9, 0, 2, [0.0, 0.0, 9.0, 9.0]), ("PLACE_DATE", "Huế", None, 0, None, 1, 1, [0.0, 0.0, 0.0, 9.0]), ("RECIPIENTS", "Nơi nhận: A", 3, 2, 9.0, 4, 9, [0.0, 0.0, 9.0, 9.0]),
        ("DOC_SUBJECT", "số 5", 2, 1, None, 0, 2, [0.0, 0.0, 9.0, 9.0]),
    ]
    frame = spark.createDataFrame(rows, "l string, t string, w int, n int, c double, p int, k int, b array<double>")
    got = [r[0] for r in frame.select(A.instance_score(*(F.col(c) for c in "ltwncpkb"))).collect()]
    assert got == pytest.approx([0.16 + 0.15 + 0.9 + 1.2 + 1.0, 0.08 + 0.15 + 0.65 - 1.0 - 2.0 - 1.0, 0.24 + 0.30 + 2.0 + 1.2 + 0.6, 0.16 + 0.15 + 1.0 - 2.5 - 1.5])


def test_candidate_match(spark):
    gold = [("g1", ["a", "b", "c", "d"]), ("g2", ["e"]), ("g3", [])]
    frame = spark.createDataFrame([(["a", "b", "c", "d"], gold), (["a", "b"], gold), (["a", "x", "y", "z", "u", "v", "w"], gold), (["q"], gold), (["e", "e"], gold)], "w array<string>, g array<struct<field_id:string,word_ids:array<string>>>")
    got = [(m.target, m.field_id, m.overlap, round(m.f1, 3)) for m in (r[0] for r in frame.select(A.candidate_match(F.lit("DOC_SUBJECT"), F.col("w"), F.col("g"))).collect())]
    assert got == [(1, "g1", 4, 1.0), (None, "g1", 2, 0.667), (0, "g1", 1, 0.182), (0, None, 0, 0.0), (1, "g2", 1, 1.0)]


def test_repaired_tags():
    line = lambda n, y=0.0: [[10.0 * i, y, 10.0 * i + 8, y + 10] for i in range(n)]
    assert A.repaired_tags(["B-X", "B-X", "O", "I-X"], line(4), [0.9, 0.9, 0.5, 0.9]) == (["B-X", "I-X", "I-X", "I-X"], 1, 1)
    assert A.repaired_tags(["B-X", "O", "I-X"], line(3), [0.9, 0.8, 0.9])[0] == ["B-X", "O", "I-X"]  # too sure
    assert A.repaired_tags(["B-X", "O", "O", "I-X"], line(4), [0.0] * 4)[0][1] == "O" and A.repaired_tags(["B-RECIPIENTS", "O", "O", "I-RECIPIENTS"], line(4), [0.0] * 4)[2] == 1
    assert A.repaired_tags(["B-SIGNER_NAME", "B-SIGNER_NAME"], line(2), None)[1] == 0
    far = [[0.0, 0.0, 8.0, 10.0], [0.0, 30.0, 8.0, 40.0]]
    assert A.repaired_tags(["B-X", "B-X"], far, None)[1] == 0 and A.repaired_tags(["B-DOC_SUBJECT", "B-DOC_SUBJECT"], far, None)[1] == 1
    assert A.repaired_tags([], [], None) == ([], 0, 0)


def test_token_parts():
    assert [(p["text"], p["box"], p["start"], p["end"]) for p in A.token_parts("12/QĐ-UBND", [0.0, 0.0, 100.0, 10.0], 5)] == [("12/QĐ", [0.0, 0.0, 50.0, 10.0], 5, 10), ("-", [50.0, 0.0, 60.0, 10.0], 10, 11), ("UBND", [60.0, 0.0, 100.0, 10.0], 11, 15)]
    assert A.token_parts("abc", [0.0, 0.0, 1.0, 1.0], 0)[0]["text"] == "abc" and len(A.token_parts("", [0.0] * 4, 0)) == 1


def test_merged_regions():
    region = lambda i, kind, x, source=None: {"id": i, "type": kind, "bbox": [x, 0.0, 10.0, 10.0], "source": source}
    out = A.merged_regions([region("a", "Footnote", 0.0)], [region("b", "Footnote", 0.01), region("c", "Footnote", 1.0), region(None, "Page-header", 0.0, "own"), region("d", "table", 3.0), {"id": "e", "type": "Footnote", "bbox": None, "source": None}])
    assert [(r["id"], r["source"]) for r in out] == [("a", None), ("doclaynet_c", "doclaynet"), ("doclaynet_2", "own")]
    assert A.merged_regions(None, None) == []


def test_word_labels(spark):
    pieces = spark.createDataFrame([(1, 0, [0.0, 0.0, 50.0]), (1, 0, [0.0, 3.0, 0.0]), (1, 1, [1.0, 1.0, 0.0])], "r int, w int, z array<double>")
    words = spark.createDataFrame([(1, 0), (1, 1), (1, 2)], "r int, w int")
    found = {r.w: (r.label, round(r.score, 3)) for r in A.word_labels(pieces, words, ["r", "w"], "z", ["O", "B-a", "I-a"]).collect()}
    assert found == {0: ("I-a", 0.523), 1: ("O", 0.422), 2: ("O", 0.0)}


def test_page_numbers_and_bullets(spark):
    rows = [(1, 0, 5.0, "12"), (1, 1, 9.0, "- 3 -"), (1, 2, 20.0, "-12-"), (1, 3, 30.0, "(12)"), (1, 4, 40.0, "text"), (1, 5, 50.0, "123."), (1, 6, 3.0, "...")]
    frame = spark.createDataFrame(rows, "page int, ord int, y double, text string")
    assert {r.ord for r in A.page_numbers(frame, ["page"]).collect() if r.is_page_number} == {0, 5}
    texts = {"1. a": True, "1.2.3.": True, "18.000 đồng": False, "IV. x": True, "đ) x": True, "12)": True, "(a) x": True, "(a)": False, "2024.": False, "12345.": True, "a. x": False}
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", A.numbered_bullet(F.col("t")).alias("b")).collect()
    assert {r.t: r.b for r in got} == texts


def test_dates_of_issue(spark):
    dates = {"5/6/2023": "05/06/2023", "2023-6-5": "05/06/2023", "31/02/2024": "31/02/2024", "Huế, ngày 5 tháng 6 năm 49": "05/06/2049", "1 - 2 - 50": "01/02/1950", "không": "không", None: ""}
    got = spark.createDataFrame([(d,) for d in dates], "d string").select(values.issue_date("d")).collect()
    assert [r[0] for r in got] == list(dates.values())


def test_form_fields(spark):
    lit = lambda x: F.lit(x).cast("string")
    form = {"number": lit(" 12 "), "symbol": lit("QĐ"), "subject": lit(""), "issuer": lit("Sở  A"), "type": lit(None), "signer": lit("B"), "secrecy": lit(None)}
    stored = {"number_symbol": lit("old"), "subject": lit("s"), "issuer": lit("i"), "superior": lit("up"), "signer": lit("x")}
    r = spark.range(1).select(*[c.alias(n) for n, c in A.metadata_overrides(stored, form, lit("05/06/2023")).items()]).first()
    assert (r.number_symbol, r.subject, r.issuer, r.superior, r.signer) == ("12-QĐ", "s", "Sở A", "", "B")
    sheet = {"number": lit("12"), "symbol": lit(None), "issuer": lit(" A "), "subject": lit(None), "signer": lit("B"), "type": lit("T"), "confidentiality": lit("M"), "access": lit(None)}
    r = spark.range(1).select(*[c.alias(n) for n, c in A.fields_of_form(sheet, lit("2023-06-05")).items()]).first()
    assert (r.number_symbol, r.issuer, r.subject, r.secrecy, r.circulation, r.place_date) == ("Số: 12", "A", "", "M", "", "2023-06-05")


def test_fields_in_order(spark):
    words = [("w1", "l2", "ba", [0.0, 20.0, 5.0, 30.0]), ("w2", "l1", "hai", [20.0, 0.0, 30.0, 10.0]), ("w3", "l1", "một", [0.0, 0.0, 10.0, 10.0])]
    frame = spark.createDataFrame([(["w1", "w2", "no", "w3", "w2"], words, ["l1", "l2"]), ([], words, ["l1"])], "ids array<string>, words array<struct<id:string,line_id:string,text:string,box:array<double>>>, lines array<string>")
    first, second = (r.field for r in B.fields_in_order(frame, "ids", "words", "lines").collect())
    assert (first.word_ids, first.line_ids, first.box, first.text) == (["w3", "w2", "w1"], ["l1", "l2"], [0.0, 0.0, 30.0, 30.0], "một hai\nba")
    assert (second.word_ids, second.box, second.text) == ([], None, "")


def test_grid_similarity(spark):
    rows = [(1, [["a", "bcd"], ["e"]], [["a", "bcx"]]), (2, [], []), (3, [["x"]], [["x"]])]
    found = {r.k: r for r in B.grid_similarity(spark.createDataFrame(rows, "k int, g array<array<string>>, p array<array<string>>"), "k", "g", "p", repair.normalize_cell).collect()}
    assert (found[1].exact_rate, found[1].cells, found[1].same) == (0.5, 4, False) and found[1].text_accuracy == pytest.approx((1 + 2 / 3 + 0 + 1) / 4)
    assert (found[2].exact_rate, found[2].text_accuracy, found[2].cells) == (1.0, 1.0, 0) and found[3].same


def _page():
    texts = [("l1", 20.0, 300.0, "CỘNG HÒA XÃ HỘI"), ("l2", 40.0, 20.0, "Số: 12/QĐ ngày"), ("l3", 60.0, 20.0, "Kính gửi: Sở"), ("l4", 600.0, 20.0, "Nơi nhận:"), ("l5", 620.0, 20.0, "- Như trên"), ("l6", 640.0, 300.0, "Nguyễn Văn An"), ("l7", 10.0, 0.0, " ")]
    words = [{"id": f"{i}_{k}", "line_id": i, "order": k, "text": w, "has_space_after": True, "box": [x + 40.0 * k, y, x + 40.0 * k + 38, y + 12]} for i, y, x, t in texts for k, w in enumerate(t.split())]
    lines = [{"id": i, "order": n, "text": t, "box": [x, y, x + 40.0 * len(t.split()), y + 12], "word_ids": [f"{i}_{k}" for k in range(len(t.split()))]} for n, (i, y, x, t) in enumerate(texts)]
    return lines, words


def test_runs_of_several_pages_at_once(spark):
    """Pages measured together give what each gives alone; a page of 400 lines took seconds when each run was measured alone."""
    lines, words = _page()
    many = [{"id": f"m{i}", "order": i, "text": "Kính gửi" if i == 390 else "nơi" if i == 4 else "nhận" if i == 5 else "a b", "box": [0.0, 2.0 * i, 300.0, 2.0 * i + 1], "word_ids": [f"m{i}_0"]} for i in range(400)]
    blank = [{"id": "b", "order": i, "text": "x", "box": [0.0, 9.0 * i, 9.0, 9.0], "word_ids": []} for i in range(3)]
    pages, fields = [lines, [], many, blank], tuple(C.MOST)
    start = time.perf_counter()
    shown, (page, field, first, n), _ = C.pages_candidates(fields, ("line_span",), pages, [[]] * 4, [595.0] * 4, [842.0] * 4, ["primary"] * 4)
    assert time.perf_counter() - start < 1
    for i, own in enumerate(pages):
        alone = [(c["field"], c["line_ids"]) for c in C.page_candidates(fields, ("line_span",), own, [], 595.0, 842.0, "primary")]
        together = [(fields[k], [x["id"] for x in shown[p][a : a + m]]) for p, k, a, m in zip(page, field, first, n, strict=True) if p == i]
        assert sorted(alone) == sorted(together)
    assert {fields[k] for p, k in zip(page, field, strict=True) if p == 3} and all(sum((page == 3) & (field == k)) <= 1 for k in range(len(fields)))  # equal words: the first
    line = "array<struct<id:string,order:int,text:string,box:array<double>,word_ids:array<string>>>"
    word = "array<struct<id:string,line_id:string,order:int,text:string,has_space_after:boolean,box:array<double>>>"
    frame = spark.createDataFrame([(1, lines, words, 595.0, 842.0, "primary")], f"doc_id int, lines {line}, words {word}, width double, height double, role string")
    whole, short = C.candidates(frame), C.candidates(frame, columns=("field", "n_lines"))
    assert sorted((r.field, len(r.line_ids)) for r in whole.collect()) == sorted((r.field, r.n_lines) for r in short.collect())


def test_field_candidates(spark):
    lines, words = _page()
    find = lambda field, source: [c["text"] for c in C.page_candidates((field,), (source,), lines, words, 595.0, 842.0, "primary")]
    assert find("REGIME_HEADER", "line_span") == ["CỘNG HÒA XÃ HỘI"]  # the next line's centre is too far left
    assert find("RECIPIENTS", "line_span") == ["Nơi nhận:", "Nơi nhận:\n- Như trên", "Nơi nhận:\n- Như trên\nNguyễn Văn An"]
    assert find("ADDRESSEE", "line_span") and all("Kính gửi" in t for t in find("ADDRESSEE", "line_span"))
    assert find("SIGNER_NAME", "word_window") == ["Nguyễn Văn", "Nguyễn Văn An", "Văn An"]
    assert find("DOC_NUMBER_SYMBOL", "word_window") == []  # the word and its number would have to be one
    assert find("PLACE_DATE", "word_window") == ["Số:", "Số: 12/QĐ", "Số: 12/QĐ ngày", "12/QĐ", "12/QĐ ngày", "ngày"]
    assert [C.like_name(t) for t in ("Nguyễn Văn An", "nguyễn văn an", "Nguyễn", "A B C D E F G", "Trần 2 An", "NGUYỄN VĂN an")] == [True, False, False, False, False, True]
    line = "array<struct<id:string,order:int,text:string,box:array<double>,word_ids:array<string>>>"
    word = "array<struct<id:string,line_id:string,order:int,text:string,has_space_after:boolean,box:array<double>>>"
    frame = spark.createDataFrame([(1, lines, words, 595.0, 842.0, "primary"), (2, None, None, 595.0, 842.0, "signature")], f"doc_id int, lines {line}, words {word}, width double, height double, role string")
    found = C.candidates(frame, ("SIGNER_NAME",))
    assert found.columns[0] == "doc_id" and {r.source for r in found.collect()} == {"line_span", "word_window"} and {r.doc_id for r in found.collect()} == {1}


def test_candidates_of_whole_documents(spark, tmp_path):
    """All pages have runs, not the first two alone, and all words of a line windows, not the first twenty."""
    text = "\n".join(["a " * 40 + "ngay x"] * 130)
    spark.createDataFrame([(1, text)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {(r.page, r.field): (r.n, r.longest) for r in annotations.g06_line_spans(spark, str(tmp_path)).collect()}
    assert {page for page, _ in found} == {0, 1, 2, 3}
    assert [found[page, "PLACE_DATE"] for page in (1, 2, 3)] == [(40 + 39 + 38, 3), (40 + 39 + 38, 3), (10 + 9 + 8, 3)]
    ends = [r.page for r in annotations.g07_word_windows(spark, str(tmp_path)).collect() if (r.field, r.text) == ("PLACE_DATE", "ngay x")]
    wanted = [pos // 40 for pos in range(40, 130) if (pos + 7) % 26 >= len(PLANTED)]
    assert sorted(p for p in ends if p) == wanted


def test_objects_of_a_batch():
    """What is made of a batch's arrays gives what whole lines and words give: with repeated words, lines without words, words of other lines, and cut batches."""
    lines, words = _page()
    twice = [{**x, "word_ids": ["l1_0", "l2_0"] if n % 2 else []} for n, x in enumerate(lines)]
    pages = [(lines, words), (None, None), (twice, words), (lines, words[::-1] + words[:2]), ([], words), (lines[:2], [])]
    line = pa.list_(pa.struct([("id", pa.string()), ("order", pa.int32()), ("text", pa.string()), ("box", pa.list_(pa.float64())), ("word_ids", pa.list_(pa.string()))]))
    word = pa.list_(pa.struct([("id", pa.string()), ("line_id", pa.string()), ("order", pa.int32()), ("text", pa.string()), ("has_space_after", pa.bool_()), ("box", pa.list_(pa.float64()))]))
    whole, fields = pa.record_batch([pa.array([p[0] for p in pages], line), pa.array([p[1] for p in pages], word)], ["lines", "words"]), tuple(C.MOST)
    for batch in (whole, whole.slice(2, 3), whole.slice(1, 1)):
        rest = [[x] * batch.num_rows for x in (595.0, 842.0, "signature")]
        for sources in (("line_span",), ("word_window",), ("line_span", "word_window")):
            _, wanted, windows = C.pages_candidates(fields, sources, batch.column("lines").to_pylist(), batch.column("words").to_pylist(), *rest)
            for slim in (True, False):
                own, known, plain = C._objects(batch, fields, sources, slim)
                _, found, also = C.pages_candidates(fields, sources, own, known, *rest, plain)
                assert [x.tolist() for x in found] == [x.tolist() for x in wanted] and also == windows
