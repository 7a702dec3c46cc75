from __future__ import annotations

from paperloom.sources import files


def test_json_and_csv_round_trips(spark, tmp_path):
    df = spark.createDataFrame([(1, "é"), (2, None)], "id long, text string")
    files.write_json(df, str(tmp_path / "j"))
    assert sorted(map(tuple, files.read_json(spark, str(tmp_path / "j"), "id long, text string").collect())) == [(1, "é"), (2, None)]
    files.write_csv(df, str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 2


def test_qrels(spark, tmp_path):
    (tmp_path / "q.tsv").write_text("query-id\tcorpus-id\tscore\nq1\td2\t1\nq1\td1\t2\nq2\td1\t0\n")
    assert [tuple(r) for r in files.read_qrels(spark, str(tmp_path / "q.tsv")).collect()] == [("q1", ["d1", "d2"])]


def test_wire_messages(spark):
    message = bytes([0x08, 0x96, 0x01, 0x12, 0x03]) + b"abc" + bytes([0x1D, 1, 0, 0, 0, 0x22, 0x09])
    rows = files.decoded_messages(spark.createDataFrame([(1, bytearray(message)), (2, None)], "id long, data binary"), "id", "data").collect()
    assert [(r.id, r.field, r.kind, r.number, bytes(r.bytes) if r.bytes is not None else None) for r in rows] == [(1, 1, 0, 150, None), (1, 2, 2, None, b"abc"), (1, 3, 5, 1, b"\x01\x00\x00\x00")]


def test_file_listing(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.pdf").write_bytes(b"1")
    (tmp_path / "y.txt").write_bytes(b"2")
    assert [r.length for r in files.files(spark, str(tmp_path), "*.pdf").collect()] == [1]
