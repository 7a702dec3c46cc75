"""Search and order-dependent operators over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fuzzy
from ..operators import greedy
from ..operators import search as S
from ..streaming import ingest
from .bindings import lines, sql_padded, sql_tokens, table, with_archive
from .registry import query

_PHRASE = f"(SELECT doc_id, ((length(t) - length(replace(t, q, ''))) // length(q))::BIGINT AS matches FROM (SELECT doc_id, {sql_padded('text')} AS t, {sql_padded("'and the'")} AS q FROM documents))"


@query(f"SELECT doc_id, token, count(*)::BIGINT AS tf FROM (SELECT doc_id, unnest({sql_tokens('text')}) AS token FROM documents) GROUP BY doc_id, token")
def j02_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.postings(table(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", "token", "tf")


@query(f"""WITH p AS (SELECT doc_id, token, count(*) AS tf, any_value(dl) AS dl FROM (SELECT doc_id, unnest(t) AS token, len(t) AS dl FROM (SELECT doc_id, {sql_tokens('text')} AS t FROM documents)) GROUP BY doc_id, token),
n AS (SELECT count(*) AS n_docs, avg(dl) AS mean FROM (SELECT doc_id, any_value(dl) AS dl FROM p GROUP BY doc_id)),
h AS (SELECT *, count(*) OVER (PARTITION BY token) AS df FROM p WHERE token IN ('licensed', 'gnu', 'version'))
SELECT doc_id, round(sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean)))::DOUBLE, 6) AS score FROM h, n GROUP BY doc_id""")
def j06_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = S.bm25_scan(table(spark, sf_dir, "documents"), "doc_id", "text", "licensed GNU version")
    return scores.select("doc_id", F.round("score", 6).alias("score"))


@query(f"SELECT doc_id, matches FROM {_PHRASE} WHERE matches > 0")
def j10_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.exact(table(spark, sf_dir, "documents"), "doc_id", "text", "and the")


@query()
def j10_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact hits, then fuzzy hits of the other documents."""
    return S.search(table(spark, sf_dir, "documents"), "doc_id", "text", "licensed under")


@query()
def h04_fuzzy_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", fuzzy.fuzzy_frequency(F.col("text"), F.lit("general licence")).alias("matches"))


@query("SELECT c_custkey, damerau_levenshtein(c_mktsegment, c_name)::BIGINT AS distance FROM customer")
def h07_edit_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", fuzzy.damerau_distance("c_mktsegment", "c_name").alias("distance"))


@query()
def i38_row_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", fuzzy.similarity("c_mktsegment", "c_name").alias("ratio"))



def _sheet() -> Column:
    """A page of a document."""
    return F.concat(F.col("doc_id").cast("string"), F.lit("/"), F.col("page").cast("string")).alias("sheet")


@query()
def e17_suppressed_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = lines(spark, sf_dir).select(_sheet(), F.col("pos").cast("long").alias("pos"), F.length("line").alias("score"), "x0", "y0", "x1", "y1")
    return greedy.suppressed(own, "sheet", "pos", "score", 0.5)


@query()
def c14_matched_instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line of an order takes the free supplier of most quantity."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), "l_suppkey", "l_quantity")
    own, other = items.select("l_orderkey", "l_linenumber"), items.select("l_orderkey", "l_suppkey", "l_quantity").groupBy("l_orderkey", "l_suppkey").agg(F.max("l_quantity").alias("l_quantity"))
    return greedy.matched(own.join(other, "l_orderkey"), "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity")


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS begin, event_type, count(*)::BIGINT AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def l01_windowed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.windowed_counts(table(spark, sf_dir, "events")).withColumn("total", F.round("total", 6))


@query(with_archive(f"SELECT file_name, count(*)::BIGINT AS hits, sum(CASE WHEN r <= 3 THEN matches END)::BIGINT AS score_total FROM (SELECT file_name, matches, row_number() OVER (PARTITION BY file_name ORDER BY matches DESC) AS r FROM {_PHRASE} JOIN docs USING (doc_id) WHERE matches > 0) GROUP BY file_name"))
def d06_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits by file, with the best three scores."""
    from .bindings import documents

    hits = S.exact(documents(spark, sf_dir), "doc_id", "text", "and the").join(documents(spark, sf_dir).select("doc_id", "file_name"), "doc_id")
    return S.top_per_file(hits, "file_name", "matches")


@query()
def b02_advanced_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose first line has the tokens of a filter, near or in order."""
    first = F.element_at(F.split("text", "\n"), 1)
    return table(spark, sf_dir, "documents").select("doc_id", fuzzy.advanced_text_match(F.lit("the of"), first).alias("found")).where("found")


@query()
def j05_boosted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subject and body with their own weights."""
    from .bindings import documents

    d = documents(spark, sf_dir)
    fields = {"subject": (S.postings(d, "doc_id", "subject"), 3.0), "body": (S.postings(d, "doc_id", "text"), 1.0)}
    return S.boosted(fields, "doc_id", "licensed version")


@query()
def j08_fuzzy_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.fuzzy_postings(S.postings(table(spark, sf_dir, "documents"), "doc_id", "text"), "doc_id", "versoin licence")


@query()
def g19_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near documents of each benchmark item that don't hold it; the items are the queries."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("q"), "text")
    positives = items.select("q", (F.col("q") * 3).alias("doc_id"))
    return S.hard_negatives(items, table(spark, sf_dir, "documents"), positives)


@query()
def e16_suppressed_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = lines(spark, sf_dir).select(_sheet(), F.col("pos").cast("long").alias("pos"), F.length("line").alias("score"), F.col("y0").alias("a"), F.col("y1").alias("b"))
    return greedy.suppressed_intervals(own, "sheet", "pos", "score", 0.5)


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    sheet = F.concat(F.col("doc_id").cast("string"), F.lit("/"), F.col("page").cast("string"))
    return lines(spark, sf_dir).select(sheet.alias("sheet"), F.col("pos").cast("long").alias("pos"), "x0", "y0", "x1", "y1")


@query()
def e20_reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return greedy.reading_order(_boxes(spark, sf_dir), "sheet", "pos")


@query()
def e21_xy_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return greedy.xy_cut(_boxes(spark, sf_dir), "sheet", "pos")


@query()
def c18_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes against the same moved a little."""
    gold = _boxes(spark, sf_dir).withColumnRenamed("pos", "ord")
    moved = gold.withColumn("x0", F.col("x0") + 20).withColumn("y1", F.col("y1") - F.col("ord") % 9)
    return greedy.detections(gold, moved, "sheet")


@query()
def a28_wire_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of one string field, decoded without a schema."""
    from ..sources import files

    name = F.encode("c_name", "UTF-8")
    message = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.unhex(F.lit("12")), F.unhex(F.lpad(F.hex(F.octet_length(name)), 2, "0")), name).alias("data"))
    return files.decoded_messages(message, "c_custkey", "data").select("c_custkey", "field", "kind", F.decode("bytes", "UTF-8").alias("text"))
