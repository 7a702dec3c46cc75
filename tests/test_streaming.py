"""A stream over files gives what the batch gives."""

from __future__ import annotations

from paperloom.functions import fuzzy, udf
from paperloom.streaming import ingest
from pyspark.sql import functions as F

SF_DIR = "/root/testdata/sf0.001"


def test_windows_of_a_stream(spark, tmp_path):
    events = spark.read.parquet(f"{SF_DIR}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = ingest.file_stream(spark, str(tmp_path / "in"), events.schema, files=1)
    found = ingest.drain(ingest.windowed_counts(stream), "windows")
    plain = lambda df: sorted((r.begin, r.event_type, r.n, round(r.total, 6)) for r in df.collect())
    assert plain(found) == plain(ingest.windowed_counts(events))


def test_sliding_and_session_windows_of_a_stream(spark, tmp_path):
    events = spark.read.parquet(f"{SF_DIR}/events.parquet")
    events.repartition(2).write.parquet(str(tmp_path / "in"))
    for i, of in enumerate((ingest.sliding_counts, ingest.session_counts)):
        found = ingest.drain(of(ingest.file_stream(spark, str(tmp_path / "in"), events.schema)), f"w{i}", "complete")
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, of(events).collect())) and found.count() > 10


def test_late_events_are_dropped(spark, tmp_path):
    schema = spark.createDataFrame([], "ts timestamp, event_type string, value double").schema
    for i, rows in enumerate((["2024-01-01 10:00:00"], ["2024-01-01 15:00:00"], ["2024-01-01 10:10:00"], ["2024-01-01 14:55:00", "2024-01-02 10:00:00"])):
        spark.createDataFrame([(t,) for t in rows], "ts string").selectExpr("cast(ts as timestamp) ts", "'a' event_type", "1.0D value").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        found = ingest.windowed_counts(ingest.file_stream(spark, str(tmp_path / "in"), schema, files=1))
        query = found.writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination()
    closed = {str(r.begin): r.n for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    # The event of 10:10 came when its window was closed; that of 14:55 within the ten minutes.
    assert closed["2024-01-01 10:00:00"] == 1 and closed["2024-01-01 14:00:00"] == 1 and closed["2024-01-01 15:00:00"] == 1


def test_completed_files(spark):
    pages = spark.createDataFrame([("a", 2, 0), ("a", 2, 1), ("b", 2, 0), ("b", 2, 0)], "file_id string, num_pages int, page int").withColumn("ts", F.current_timestamp())
    assert [r.file_id for r in ingest.completed(pages).collect()] == ["a"]


def test_registered_functions(spark):
    udf.register(spark)
    row = spark.sql("SELECT damerau('ca', 'abc') AS d, folded_tokens('Đảng ủy') AS t, advanced_match('the of', 'of the thing of') AS m").first()
    assert (row.d, row.t, row.m) == (2, ["dang", "uy"], True)
    grams = spark.sql("SELECT g.* FROM VALUES ('Đảng ủy xã'), (NULL) AS t(x), LATERAL ngrams(x, 2) AS g").collect()
    assert sorted((r.place, r.size, r.gram) for r in grams) == [(0, 1, "dang"), (0, 2, "dang uy"), (1, 1, "uy"), (1, 2, "uy xa"), (2, 1, "xa")]
    assert not fuzzy.advanced_match("of the", "xx yy") and fuzzy.advanced_match("", None)
