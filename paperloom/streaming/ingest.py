"""Streaming ingest: files of events as they come, late data by watermark, completion of files by a count."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def file_stream(spark: SparkSession, path: str, schema: StructType, files: int = 16) -> DataFrame:
    """Parquet files of a folder, at most ``files`` in a micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def windowed_counts(events: DataFrame, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Events and their values by tumbling window and type; batch and stream alike."""
    counted = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type")
    return counted.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("begin"), "event_type", "n", "total")


def sliding_counts(events: DataFrame, late: str = "10 minutes", size: str = "1 hour", step: str = "20 minutes") -> DataFrame:
    """Events of windows that overlap, one begun each ``step``; batch and stream alike."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", size, step).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("begin"), "n")


def session_counts(events: DataFrame, key: str = "user_id", late: str = "10 minutes", gap: str = "30 minutes") -> DataFrame:
    """(key, begin, end, n): sessions of events no further apart than ``gap``; batch and stream alike."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(key, F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("begin"), F.col("w.end").alias("end"), "n")


def completed(pages: DataFrame, late: str = "1 day") -> DataFrame:
    """Files all of whose ``num_pages`` pages have come, each page once."""
    arrived = pages.withWatermark("ts", late).groupBy("file_id", "num_pages").agg(F.approx_count_distinct("page", 0.01).alias("pages")) if pages.isStreaming else pages.groupBy("file_id", "num_pages").agg(F.count_distinct("page").alias("pages"))
    return arrived.where(F.col("pages") >= F.col("num_pages"))


def drain(stream: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Runs the stream over all that is there into a memory table; for tests and small results."""
    stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.table(name)
