"""Ordered rows: segments, spans of labels, first and last rows, islands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def segments(cuts: DataFrame, by: str, at: str, size: str) -> DataFrame:
    """Contiguous ranges [start, end] between cuts; each group's last ends at its size - 1."""
    w = Window.partitionBy(by).orderBy(at)
    return cuts.select(by, F.col(at).alias("start"), (F.coalesce(F.lead(at).over(w), F.col(size)) - 1).alias("end"), F.row_number().over(w).alias("segment"))


def islands(rows: DataFrame, by: list[str], order: str, begins: Column) -> DataFrame:
    """``rows`` with ``island``: a running number that grows wherever ``begins`` is true."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("island", F.sum(begins.cast("int")).over(w))


def repaired(rows: DataFrame, by: list[str], order: str, tag: str = "tag") -> DataFrame:
    """An inside tag whose field does not continue the tag before it becomes a beginning."""
    field, before = F.substring(tag, 3, 100), F.lag(F.substring(tag, 3, 100), 1, "").over(Window.partitionBy(*by).orderBy(order))
    return rows.withColumn("repaired", F.when(F.col(tag).startswith("I-") & (before != field), F.concat(F.lit("B-"), field)).otherwise(F.col(tag)))


def decoded_spans(rows: DataFrame, by: list[str], order: str, tag: str, text: str, score: str) -> DataFrame:
    """Spans (field, first, last, text, score) of tags B-x, I-x, O."""
    field = F.substring(tag, 3, 100)
    before = F.lag(field, 1, "").over(Window.partitionBy(*by).orderBy(order))
    marked = rows.withColumn("field", field).withColumn("begins", (F.col(tag) != "O") & (F.col(tag).startswith("B-") | (before != field)))
    spans = islands(marked, by, order, F.col("begins")).where(F.col(tag) != "O")
    word = F.struct(F.col(order).alias("o"), F.col(text).alias("w"))
    return spans.groupBy(*by, "island", "field").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.array_join(F.array_sort(F.collect_list(word)).getField("w"), " ").alias("text"), F.avg(score).alias("score")).drop("island")
