"""Chunks, forms, workbooks, annotations and label measures, worked by hand."""

from __future__ import annotations

import io
import struct
import zipfile

import pytest
from paperloom.functions import repair, values
from paperloom.operators import chunks as C
from paperloom.operators import kie as K
from paperloom.operators import merge
from paperloom.sources import annotations, workbooks
from pyspark.sql import functions as F


def _block(i, n, y=None, region=None, word="w"):
    y = 20.0 * i if y is None else y
    return {"ord": i, "text": " ".join([word] * n), "box": [0.0, y, 100.0, y + 12], "region": region}


def _shape(chunks):
    return [(c["first"], c["last"], c["words"], c["reason"]) for c in chunks]


def test_chunks_of_a_page():
    assert C.chunks_of_page([], 12.0, True) == []
    # Up to the target blocks join; then a block of thirty words or more begins anew, a shorter one still joins.
    assert _shape(C.chunks_of_page([_block(0, 60), _block(1, 40), _block(2, 30)], 12.0, False)) == [(0, 1, 100, "body_merged"), (2, 2, 30, "body_single")]
    assert _shape(C.chunks_of_page([_block(0, 100), _block(1, 29)], 12.0, False)) == [(0, 1, 129, "body_merged")]
    # A gap over six line heights, a block above, and another region each end a paragraph; a tiny one joins the chunk before.
    assert _shape(C.chunks_of_page([_block(0, 40, 0.0), _block(1, 40, 90.0)], 12.0, False)) == [(0, 0, 40, "body_single"), (1, 1, 40, "body_single")]
    assert _shape(C.chunks_of_page([_block(0, 40, 100.0), _block(1, 40, 50.0)], 12.0, False)) == [(0, 0, 40, "body_single"), (1, 1, 40, "body_single")]
    assert _shape(C.chunks_of_page([_block(0, 40, region="a"), _block(1, 40, region="b"), _block(2, 40)], 12.0, False)) == [(0, 0, 40, "body_single"), (1, 2, 80, "body_merged")]
    assert _shape(C.chunks_of_page([_block(0, 40, 0.0), _block(1, 29, 90.0), _block(2, 9, 300.0)], 12.0, False)) == [(0, 2, 78, "body_merged")]
    assert _shape(C.chunks_of_page([_block(0, 10, 0.0), _block(1, 40, 90.0)], 12.0, False)) == [(0, 0, 10, "body_single"), (1, 1, 40, "body_single")]
    # 251 words of one sentence: windows of 250 with thirty of overlap, the second within the first's end.
    parts = C.chunks_of_page([_block(0, 251)], 12.0, False)
    assert _shape(parts) == [(0, 0, 250, "body_split_1"), (0, 0, 31, "body_split_2")]
    assert _shape(C.chunks_of_page([_block(0, 250)], 12.0, True)) == [(0, 0, 250, "body_single")]


def test_long_texts_are_split_by_sentences_with_overlap():
    a, b, c = ("a " * 200).strip() + ".", ("b " * 100).strip() + ".", ("c " * 300).strip() + "."
    first, second, third = C.split_long(f"{a} {b} {c}")
    assert (len(first.split()), second.split()[:31], len(second.split())) == (200, ["a"] * 29 + ["a.", "b"], 130)
    assert third.split()[:31] == ["b"] * 29 + ["b.", "c"] and len(third.split()) == 330  # a longer sentence stays whole


def test_chunks_of_documents(spark):
    box = lambda y: [0.0, y, 10.0, y + 10.0]
    words = lambda n: " ".join(["chữ"] * n)
    rows = [(1, 0, 0, "Trang 5", box(0.0), None, 10.0), (1, 0, 1, words(50), box(20.0), None, 10.0), (1, 0, 2, words(20), box(40.0), None, 10.0), (1, 1, 3, words(5), box(0.0), None, None), (2, 0, 0, "123", box(0.0), None, None)]
    frame = spark.createDataFrame(rows, "doc_id long, page int, ord long, text string, box array<double>, region string, font_size double")
    found = [(r.doc_id, r.page, r.chunk, r.first, r.last, r.words) for r in C.chunked(frame).orderBy("doc_id", "chunk").collect()]
    assert found == [(1, 0, 1, 1, 2, 70), (1, 1, 2, 3, 3, 5)]


def test_packs_and_lines(spark):
    frame = spark.createDataFrame([(["a", "b", "c", "d"], [100, 50, 200, 10]), ([], [])], "w array<string>, n array<long>")
    assert [r[0] for r in frame.select(C.token_packs(F.col("w"), F.col("n"), 150)).collect()] == [["a b", "c", "d"], []]
    text = "short\n" + "One sentence here. Another?  Third"
    assert spark.createDataFrame([(text,), ("",)], "t string").select(C.prepared_lines(F.col("t"), 20).alias("l")).collect()[0].l == ["short", "One sentence here.", "Another?", "Third"]


def test_forms(spark):
    dates = {"2024-1-5": "05/01/2024", " 5.3.31 ": "05/03/1931", "5-3-30": "05/03/2030", "ngày 31/02/2024": "31/02/2024", " chưa rõ ": "chưa rõ", None: ""}
    frame = spark.createDataFrame([(k,) for k in dates], "d string")
    assert [r[0] for r in frame.select(values.display_date("d")).collect()] == list(dates.values())
    types = {"Kê khai tài sản, thu nhập": "KÊ KHAI TÀI SẢN, THU NHẬP", "QUYẾT  ĐỊNH: về": "QUYẾT ĐỊNH", "quyết địnhx": None, "": None, "Phiếu gửi/1": "PHIẾU GỬI", None: None}
    frame = spark.createDataFrame([(k,) for k in types], "d string")
    assert [r[0].name for r in frame.select(values.explicit_type("d")).collect()] == list(types.values())
    assert values.is_active({"a": "", "b": 0}) and not values.is_active({"a": "", "b": [], "c": None}) and not values.is_active(None)
    assert repair.lookalikes("ВӘн a") == "BӘh a" and repair.surface("Χ κορυχ a") == "X kopyx a" and repair.surface("abc Ж") == ""


def _workbook(shared: bool) -> bytes:
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    cells = '<c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>Phông</t></is></c>' if shared else '<c r="A1" t="inlineStr"><is><t>x</t></is></c>'
    parts = {
        "xl/workbook.xml": f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="Hồ sơ" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{main}"><sheetData><row r="1">{cells}</row><row r="2"/><row r="3"><c r="A3"><v>12.5</v></c><c r="C3" t="inlineStr"><is><t>F1</t></is></c></row></sheetData></worksheet>',
        "xl/sharedStrings.xml": f'<sst xmlns="{main}"><si><r><t>Tiêu đề </t></r><r><t> hồ sơ</t></r></si></sst>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as book:
        for name, text in parts.items():
            book.writestr(name, text)
    return out.getvalue()


def test_workbooks(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "metadata.xlsx").write_bytes(_workbook(True))
    (tmp_path / "broken.xlsx").write_bytes(b"PK no book")
    rows = workbooks.read_workbooks(spark, f"file://{tmp_path}")
    assert {(r.sheet, r.row, tuple(r["values"])) for r in rows.collect()} == {("Hồ sơ", 1, ("Tiêu đề  hồ sơ", None, "Phông")), ("Hồ sơ", 2, ()), ("Hồ sơ", 3, ("12.5", None, "F1"))}
    found = workbooks.read_sheet(rows, {"Tiêu\xa0đề hồ sơ": "title", "Phông": "fonds", "Mục lục": "catalog"})
    assert [tuple(r) for r in found.collect()] == [("12.5", "F1", None)] and found.columns == ["title", "fonds", "catalog"]
    assert workbooks.read_sheet(rows, {"none": "x"}).count() == workbooks.read_sheet(rows.limit(0), {"none": "x"}).count() == 0


def _field(number: int, value) -> bytes:
    if isinstance(value, int):
        out, n = bytes([number << 3]) if number < 16 else bytes([(number << 3) & 0x7F | 0x80, number >> 4]), value
        while n > 0x7F:
            out, n = out + bytes([n & 0x7F | 0x80]), n >> 7
        return out + bytes([n])
    if isinstance(value, float):
        return bytes([number << 3 | 5]) + struct.pack("<f", value)
    raw = value.encode() if isinstance(value, str) else value
    return bytes([(number << 3 | 2) & 0x7F | (0x80 if number > 15 else 0)]) + (bytes([number >> 4]) if number > 15 else b"") + bytes([len(raw)]) + raw


def test_visual_annotations(spark):
    box = b"".join(_field(i, v) for i, v in ((1, 3), (2, 4), (3, 300), (4, 12), (5, 0.5)))
    symbol = _field(1, box) + _field(2, "đ") + _field(3, 0.25)
    word = _field(1, symbol) + _field(2, box) + _field(3, "định") + _field(6, 1) + _field(7, 1) + _field(10, 0x11223300) + _field(13, 8) + _field(15, 0.75)
    line = _field(1, word) + _field(1, _field(3, "plain")) + _field(2, box) + _field(3, "định plain") + _field(5, 7) + _field(10, 0.5) + _field(11, 2)
    frame = spark.createDataFrame([(1, _field(1, b"ui") + _field(2, line) + _field(2, b"")), (2, None), (3, _field(2, line)[:-5])], "i int, data binary")
    first, second, third = annotations.visual_annotations(frame, "data").orderBy("i").collect()
    assert len(first.lines) == 2 and second.lines == third.lines == []
    own, empty = first.lines
    assert (own.text, own.block_id, own.paragraph_id, own.confidence, own.box.asDict()) == ("định plain", 7, 2, 0.5, {"x": 3, "y": 4, "width": 300, "height": 12, "angle": 0.5})
    w, plain = own.words
    assert (w.text, w.has_space_after, w.content_type, w.confidence, w.foreground, w.symbols[0].text, w.symbols[0].confidence) == ("định", True, 8, 0.75, [0x11, 0x22, 0x33], "đ", 0.25)
    assert (plain.foreground, plain.box, empty.text, empty.words) == (None, None, "", [])


def test_word_counts(spark):
    rows = spark.createDataFrame([(["B-a", "I-a", "O", "B-b", "B-b"], ["B-a", "B-b", "I-a", "O"]), ([], ["B-a"])], "g array<string>, p array<string>")
    found = {r.field: tuple(r)[1:] for r in K.word_counts(rows, "g", "p").collect()}
    assert found == {"a": (2, 2, 1, 1, 1), "b": (1, 1, 0, 1, 1), None: (3, 3, 1, 2, 2)}


def test_span_metrics(spark):
    span = lambda words, box=(0.0, 0.0, 10.0, 10.0): (words, list(box))
    rows = [("a", [span(["1", "2"]), span(["5", "6"])], [span(["5"], (0.0, 0.0, 5.0, 10.0)), span(["1", "2"]), span(["9"])]), ("b", [span(["3"])], None), ("a", None, [span(["7", "8"])])]
    frame = spark.createDataFrame(rows, f"field string, g array<{K.SPAN}>, p array<{K.SPAN}>")
    found = {r.field: r for r in K.span_metrics(frame, "g", "p").collect()}
    a, b, total = found["a"], found["b"], found[None]
    assert (a.precision, a.recall, a.exact) == (pytest.approx(1 / 3), 0.5, 0.5) and a.missing_rate == 1 / 4 and a.extra_rate == pytest.approx(3 / 6) and a.mean_iou == 0.75
    assert (b.precision, b.recall, b.f1, b.missing_rate, b.extra_rate, b.mean_iou) == (0, 0, 0, 1, 0, 0)
    assert total.missing_rate == 2 / 5 and total.f1 == pytest.approx(2 / (2 + 2 + 2))


def test_thresholds(spark):
    rows = spark.createDataFrame([("a", 0.9, True), ("a", 0.6, True), ("a", 0.4, False), ("b", 0.8, False), ("b", 0.3, True)], "field string, score double, gold boolean")
    settings = [{"a": 0.5, "b": 0.5}, {"a": 0.95, "b": 0.9}, {"a": 0.4, "b": 0.1}]
    assert K.threshold_objectives(rows, settings) == pytest.approx([4 / 6, 0.0, 6 / 8])
    found, best = K.tuned_thresholds(lambda s: K.threshold_objectives(rows, s), {"a": 0.95, "b": 0.9}, {"a": [0.4, 0.5, 0.6], "b": [0.1, 0.9]})
    assert found == {"a": 0.5, "b": 0.1} and best == pytest.approx(6 / 7)


def test_selected_documents(spark):
    docs = spark.createDataFrame([("a", 3, "p3"), ("b", 2, "p2"), ("c", 2, "p1"), ("d", 1, "q2"), ("e", 1, "q1")], "doc_id string, pages int, path string")
    pick = lambda n, m: sorted(r.doc_id for r in K.selected_documents(docs, n, m).collect())
    assert pick(3, 1) == ["c", "d", "e"] and pick(4, 1) == ["b", "c", "d", "e"] and pick(2, 2) == ["b", "c"]
    with pytest.raises(ValueError, match="fewer than 6"):
        K.selected_documents(docs, 6, 1)


def test_history_and_versions(spark, tmp_path):
    history = spark.createDataFrame([(4, "x", 1, "done")], "import_id long, source string, started_at long, status string")
    assert sorted(tuple(r) for r in merge.begun(history, "y", 9).collect()) == [(4, "x", 1, "done"), (5, "y", 9, "running")]
    assert merge.begun(history.limit(0), "y", 9).first().import_id == 1
    first = merge.committed(history, f"file://{tmp_path}/t")
    second = merge.committed(history.withColumn("status", F.lit("new")), f"file://{tmp_path}/t")
    assert (first.first().status, second.first().status) == ("done", "new")
