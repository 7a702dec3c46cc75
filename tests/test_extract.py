"""Fields of documents, worked by hand."""

from __future__ import annotations

from paperloom.operators import extract as E


def _line(text, y, x=60.0, w=200.0, kind=None, grey=128, block=None, h=12.0):
    return (text, float(x), float(y), float(w), h, kind, grey, block)


SCHEMA = f"doc_id long, page int, width double, height double, lines array<{E.LINE}>, regions array<{E.REGION}>"


def _fields(spark, *pages):
    rows = [(doc, page, 595.0, 842.0, lines, regions) for doc, page, lines, regions in pages]
    return {r.doc_id: r.asDict() for r in E.document_fields(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_fields_of_a_state_document(spark):
    first = [
        _line("ỦY BAN NHÂN DÂN", 40, block=1), _line("TỈNH HÀ NAM", 54, grey=20, block=1), _line("CỘNG HÒA XÃ HỘI CHỦ NGHĨA VIỆT NAM", 40, 320), _line("Độc lập - Tự do - Hạnh phúc", 54, 340), _line("----", 66, kind=4),
        _line("Số: 123 /QĐ-UBND", 80), _line("Hà Nam, ngày 03 tháng 4 năm 2024 (bản 2)", 80, 330), _line("QUYẾT ĐỊNH", 150, 250, 100), _line("Phê duyệt quy hoạch", 165, 200), _line("của thành phố Phủ Lý", 180, 200),
        _line("Căn cứ Luật Tổ chức", 195), _line("khác", 208),
    ]
    second = [_line("Nơi nhận:", 600), _line("KT. CHỦ TỊCH", 610, 350), _line("PHÓ CHỦ TỊCH", 625, 350), _line("", 650, 350, kind=8), _line("Nguyễn Văn An", 690, 350), _line("Trần Thị Bình", 700, 40)]
    third = [_line("PHỤ LỤC I", 40), _line("Lê Văn Cường", 700, 350)]
    found = _fields(spark, (1, 0, first, []), (1, 1, second, []), (1, 2, third, []))[1]
    assert (found["doc_type"], found["number_and_symbol"], found["number"], found["symbol"]) == ("nhanuoc", "Số 123/QĐ-UBND", None, None)
    assert (found["issuer"], found["issue_date"]) == ("ỦY BAN NHÂN DÂN TỈNH HÀ NAM", "Hà Nam, ngày 03 tháng 4 năm 2024")
    assert found["subject"] == "QUYẾT ĐỊNH Phê duyệt quy hoạch của thành phố Phủ Lý"
    assert (found["signer"], found["type"]) == ("Nguyễn Văn An", "Quyết định")


def test_fields_of_a_party_document(spark):
    only = [
        _line("ĐẢNG CỘNG SẢN VIỆT NAM", 40, 330), _line("TỈNH ỦY HÀ NAM", 40, block=3, grey=90), _line("VĂN PHÒNG", 54, block=4, grey=100), _line("*", 66), _line("Số 45-CV/VPTU", 80), _line("Ha Nam, ngay 5 thang 6 nam 2023", 80, 330),
        _line("V/v: chuẩn bị hội nghị", 95), _line("tổng kết năm", 108), _line("Kính gửi: các huyện ủy", 120), _line("Nội dung thư", 300), _line("NGUYỄN VĂN TÁM", 700, 340), _line("PHÒNG NỘI VỤ", 715, 340),
    ]
    found = _fields(spark, (2, 0, only, None))[2]
    assert (found["doc_type"], found["number_and_symbol"], found["number"], found["symbol"]) == ("dang", "Số 45-CV/VPTU", "45", "CV/VPTU")
    assert (found["issuer"], found["issue_date"], found["type"]) == ("VĂN PHÒNG", "Ha Nam, ngay 5 thang 6 nam 2023", "Công văn")
    assert (found["subject"], found["signer"]) == ("chuẩn bị hội nghị tổng kết năm", "NGUYỄN VĂN TÁM")


def test_fields_from_further_pages_regions_and_nothing(spark):
    blank, title = [], [_line("7:", 100), _line("Thư mời họp", 115), _line("1. Mở đầu", 130), _line("sau", 140)]
    region = [("title", [0.0, 90.0, 400.0, 200.0])]
    found = _fields(spark, (3, 0, blank, None), (3, 1, title, region), (4, 0, None, None), (5, 0, [_line("Về kế hoạch năm", 100), _line("Số: 7", 110)], None))
    assert found[3]["subject"] == "Thư mời họp" and found[3]["signer"] is None and found[3]["issuer"] is not None
    assert set(found[4].values()) == {4, "unknown", None}
    assert found[5]["subject"] == "kế hoạch năm Số: 7" and found[5]["number_and_symbol"] is None


def test_continuations_stop_at_gaps_bars_and_beside_the_body(spark):
    lines = [_line("title", 100), _line("one", 112), _line("to the right of the address", 126, 400), _line("Kính gửi: ai đó", 128), _line("two", 150)]
    frame = spark.createDataFrame([(lines,), ([_line("title", 100), _line("one", 112), _line("-----", 124), _line("two", 136)],), ([_line("title", 100), _line("far", 140)],)], f"lines array<{E.LINE}>")
    from pyspark.sql import functions as F

    got = [r[0] for r in frame.select(E.continuations(F.col("lines")[0], F.col("lines"), F.lit(842.0), 4)).collect()]
    assert got == [["one"], ["one"], []]
