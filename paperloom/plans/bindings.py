"""The driver's tables as an archive: documents, dossiers, lines and words; in DataFrames, and in SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LINES_PER_PAGE = 40


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive documents: a source is a dossier, a language a fonds; the status follows from doc_id."""
    d = table(spark, sf_dir, "documents")
    turn = F.col("doc_id") % 10
    return d.select(
        "doc_id", F.col("source").alias("dossier_id"), F.col("lang").alias("fonds"), "text", "n_chars",
        F.when(turn == 0, "deleted").when(turn == 1, "failed").when(turn == 2, "pending").otherwise("indexed").alias("status"),
        F.concat("lang", F.lit("/"), F.lpad((F.col("doc_id") % 97).cast("string"), 3, "0"), F.lit(".pdf")).alias("file_name"),
        (F.lit(1) + F.floor((F.size(F.split("text", "\n")) - 1) / LINES_PER_PAGE)).cast("long").alias("page_count"),
        F.element_at(F.split("text", "\n"), 1).alias("subject"),
    )


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Non-empty lines with page, order and box."""
    split = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    y = (F.lit(14) * F.col("pos") % 560).cast("double")
    return split.where("trim(line) <> ''").select(
        "doc_id", "pos", "line", F.floor(F.col("pos") / LINES_PER_PAGE).cast("int").alias("page"), F.lit(0.0).alias("x0"), y.alias("y0"), (F.lit(6.0) * F.least(F.length("line"), F.lit(100))).alias("x1"), (y + 12).alias("y1")
    )


SQL = """
docs AS (SELECT doc_id, source AS dossier_id, lang AS fonds, text, n_chars,
  CASE doc_id % 10 WHEN 0 THEN 'deleted' WHEN 1 THEN 'failed' WHEN 2 THEN 'pending' ELSE 'indexed' END AS status,
  lang || '/' || lpad((doc_id % 97)::VARCHAR, 3, '0') || '.pdf' AS file_name,
  (1 + (len(string_split(text, chr(10))) - 1) // 40)::BIGINT AS page_count, string_split(text, chr(10))[1] AS subject FROM documents),
split_lines AS (SELECT doc_id, unnest(range(len(string_split(text, chr(10)))))::INT AS pos, unnest(string_split(text, chr(10))) AS line FROM documents),
lines AS (SELECT doc_id, pos, line, (pos // 40)::INT AS page, 0.0::DOUBLE AS x0, ((14 * pos) % 560)::DOUBLE AS y0, 6.0::DOUBLE * least(length(line), 100) AS x1, ((14 * pos) % 560)::DOUBLE + 12 AS y1
  FROM split_lines WHERE trim(line, ' ') <> '')
"""


def with_archive(query: str) -> str:
    return f"WITH {SQL.strip()}\n{query}"


#: SQL macros in text form: folded text, folded tokens.
def sql_fold(x: str) -> str:
    return f"lower(replace(replace(strip_accents({x}), 'đ', 'd'), 'Đ', 'D'))"


def sql_tokens(x: str) -> str:
    return f"regexp_extract_all({sql_fold(x)}, '[\\p{{L}}\\p{{N}}_]+')"


def sql_padded(x: str) -> str:
    return f"' ' || array_to_string({sql_tokens(x)}, '  ') || ' '"
