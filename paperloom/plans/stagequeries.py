"""Stages of file tasks, marks by rule, and comparisons of two outputs, over the driver's rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import stages as S
from .bindings import lines, table, with_archive
from .registry import query


def _tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.left("text", F.lit(20)).alias("raw_text"))


def _fails_on_z(text: str) -> str:
    if "z" in text:
        raise ValueError("z")
    return text[::-1]


@query("SELECT conv_id, turn, CASE WHEN contains(t, 'z') THEN NULL ELSE reverse(t) END AS corrected_text, CASE WHEN contains(t, 'z') THEN 'correction failed: z' END AS error, CASE WHEN contains(t, 'z') THEN 'correction_start,file_failed' ELSE 'correction_start,correction_done' END AS events FROM (SELECT conv_id, turn, coalesce(left(text, 20), '') AS t FROM conversations)")
def l03_isolated_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corrections that fail for some tasks; the others go on."""
    return S.corrected(_tasks(spark, sf_dir), _fails_on_z).select("conv_id", "turn", "corrected_text", "error", F.array_join("events", ",").alias("events"))


@query("SELECT conv_id, turn, CASE WHEN contains(t, 'z') THEN 'correction failed: z' END AS error, CASE WHEN contains(t, 'z') THEN 'file_failed' ELSE 'file_complete' END AS last, CASE WHEN NOT contains(t, 'z') THEN length(t)::VARCHAR END AS kie_annotation FROM (SELECT conv_id, turn, coalesce(left(text, 20), '') AS t FROM conversations)")
def l04_annotated_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The annotation of tasks whose correction succeeded, and what is told last of each."""
    made = S.annotated(S.corrected(_tasks(spark, sf_dir), _fails_on_z), lambda text: str(len(text)))
    return made.select("conv_id", "turn", "error", F.element_at("events", -1).alias("last"), "kie_annotation")


_STAMPS = ("MẬT", "Mật", "- TỐI MẬT -", "HỎA TỐC", "MẶT TRẬN TỔ QUỐC", "(LƯU HÀNH NỘI BỘ)")


@query(with_archive(f"""SELECT doc_id, 'rb_' || row_number() OVER (PARTITION BY doc_id ORDER BY o) AS field_id, label, line_id, text FROM (
SELECT doc_id, CASE k WHEN 0 THEN 'SECRECY_MARK' WHEN 2 THEN 'SECRECY_MARK' WHEN 3 THEN 'URGENCY_MARK' ELSE 'CIRCULATION_MARK' END AS label, CASE WHEN k IN (0, 2) THEN 1 WHEN k = 3 THEN 2 ELSE 3 END AS o, 'l' || pos AS line_id, {list(_STAMPS)}[k + 1] AS text,
  row_number() OVER (PARTITION BY doc_id, CASE WHEN k IN (0, 2) THEN 1 WHEN k = 3 THEN 2 ELSE 3 END ORDER BY pos) AS r
FROM (SELECT doc_id, pos, page, y0, (pos % 6)::INT AS k FROM lines WHERE page = 0) WHERE k IN (0, 2, 3, 5) AND (k = 5 OR (y0 + 6) / 842.0::DOUBLE <= 0.33::DOUBLE)) WHERE r = 1 AND NOT (doc_id % 2 = 0 AND label = 'URGENCY_MARK')"""))
def b18_rule_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marks of secrecy, urgency and circulation by their own lines, but for labels that a document has."""
    text = F.element_at(F.array(*map(F.lit, _STAMPS)), (F.col("pos") % 6 + 1).cast("int"))
    box = F.array(F.lit(10.0), F.col("y0"), F.lit(100.0), F.col("y0") + 12)
    own = lines(spark, sf_dir).select("doc_id", "page", F.col("pos").alias("ord"), F.concat(F.lit("l"), "pos").alias("id"), text.alias("text"), box.alias("box"), F.lit(595.0).alias("width"), F.lit(842.0).alias("height"))
    has = table(spark, sf_dir, "documents").where("doc_id % 2 = 0").select("doc_id", F.lit("URGENCY_MARK").alias("label"))
    return S.rule_marks(own, has)


@query("SELECT doc_id, 2 AS gold_count, CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 2 END AS count, round(CASE WHEN doc_id % 3 = 0 THEN (1.0 + 0) / 2 ELSE (1.0 + 1.0 / 3 * 0.5) / 2 END, 6)::DOUBLE AS shape_accuracy, round(CASE WHEN doc_id % 3 = 0 THEN 1.0 / 2 ELSE (1.0 + 0.5) / 2 END, 6)::DOUBLE AS text_accuracy FROM documents")
def d34_table_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of two outputs one by one, some without a partner."""
    t = lambda rows, cols, text: F.struct(F.lit(rows).alias("rows"), F.lit(cols).alias("cols"), text.alias("text"))
    name = F.col("lang")
    gold = F.array(t(2, 2, name), t(1, 3, F.lit("ab")))
    found = F.when(F.col("doc_id") % 3 == 0, F.array(t(2, 2, name))).otherwise(F.array(t(2, 2, F.concat(F.lit(" "), name)), t(2, 1, F.lit("ax"))))
    rows = table(spark, sf_dir, "documents").select("doc_id", gold.alias("g"), found.alias("f"))
    return S.compared_tables(rows, "g", "f").select("doc_id", "gold_count", "count", F.round("shape_accuracy", 6).alias("shape_accuracy"), F.round("text_accuracy", 6).alias("text_accuracy"))


@query("SELECT c_custkey, round(1 - 1 / 18.0::DOUBLE, 6) AS ours, round(CASE c_custkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 1 - 1 / 18.0::DOUBLE ELSE 1 - 2 / 18.0::DOUBLE END, 6) AS theirs, CASE WHEN c_custkey % 3 = 2 THEN 'warn' ELSE 'praise' END AS verdict FROM customer WHERE length(c_name) = 18")
def d32_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sides' character accuracy against the same text, and what follows."""
    gold, turn = F.col("c_name"), F.col("c_custkey") % 3
    ours, theirs = F.concat(gold, F.lit("x")), F.when(turn == 0, gold).when(turn == 1, F.concat(F.lit("y"), gold)).otherwise(F.concat(F.lit("yy"), gold))
    rows = table(spark, sf_dir, "customer").where("length(c_name) = 18").select("c_custkey", S.side_accuracy(ours, gold).alias("ours"), S.side_accuracy(theirs, gold).alias("theirs"))
    return rows.select("c_custkey", F.round("ours", 6).alias("ours"), F.round("theirs", 6).alias("theirs"), S.verdict(F.col("ours"), F.col("theirs")).alias("verdict"))
