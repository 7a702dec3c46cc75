"""Search results: scored chunks with their document and dossier, counted and boxed by how they match."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fuzzy
from ..functions import text as T
from .boxes import matched_boxes

#: Characters of the shortest text that is a result.
LEAST_TEXT = 12


def results(scores: DataFrame, chunks: DataFrame, docs: DataFrame, dossiers: DataFrame, kind: str = "", query: str = "", only: str | None = None, words: DataFrame | None = None) -> DataFrame:
    """``chunks`` (chunk_id, doc_id, page, text, box, chunk_type) that are scored, with their document's and dossier's columns.

    Of repeated scores (chunk_id, score) the highest counts.  Texts under twelve characters and other chunk types than
    ``only`` go.  Exact and fuzzy results count the query's occurrences, those without any go, and the count is the score; with
    ``words`` (file_path, page, words) their boxes count instead, where there are any.  A missing dossier gives no title.
    """
    best = scores.groupBy("chunk_id").agg(F.max("score").alias("score"))
    rows = chunks.join(best, "chunk_id").withColumn("text", T.squeeze_ends(F.coalesce("text", F.lit("")))).withColumn("chunk_type", F.coalesce("chunk_type", F.lit("body")))
    rows = rows.where(F.length("text") >= LEAST_TEXT)
    rows = rows.where(F.col("chunk_type") == only) if only else rows
    none = F.lit(None).cast("array<array<double>>")
    rows = rows.join(docs, "doc_id").join(dossiers.select("dossier_id", F.col("title").alias("dossier_title")), "dossier_id", "left")
    if not query or kind not in ("exact", "fuzzy"):
        return rows.withColumns({"match_kind": F.lit(kind), "match_count": F.lit(0).cast("long"), "match_boxes": none})
    count = T.phrase_count("text", query) if kind == "exact" else fuzzy.fuzzy_frequency(F.col("text"), F.lit(query))
    # A generator keeps the filter from being pushed below the count, which would then be taken twice.
    rows = rows.select("*", F.explode(F.array(count)).alias("match_count")).where("match_count > 0")
    if words is not None:
        found = matched_boxes(rows.join(words, ["file_path", "page"], "left").withColumn("query__", F.lit(query)).withColumn("words", F.coalesce("words", F.array().cast("array<struct<token:string,box:array<double>>>"))), "query__", "words", "box")
        rows = found.withColumn("match_boxes", F.col("exact" if kind == "exact" else "near")).drop("exact", "near", "query__", "words")
        rows = rows.withColumn("match_count", F.when(F.size("match_boxes") > 0, F.size("match_boxes").cast("long")).otherwise(F.col("match_count")))
    else:
        rows = rows.withColumn("match_boxes", none)
    return rows.withColumn("match_kind", F.lit(kind)).withColumn("score", F.col("match_count").cast("double"))
