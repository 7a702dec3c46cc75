"""Scalar text, hash and geometry functions over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import hashing as H
from ..functions import text as T
from .bindings import lines, sql_fold, sql_tokens, table, with_archive
from .registry import query


@query("SELECT doc_id, replace(replace(strip_accents(text), 'đ', 'd'), 'Đ', 'D') AS folded FROM documents")
def h01_strip_accents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.strip_accents("text").alias("folded"))


@query(f"SELECT doc_id, len({sql_tokens('text')})::BIGINT AS n, array_to_string({sql_tokens('text')}, ' ') AS tokens FROM documents")
def h02_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.size(T.tokens("text")).cast("long").alias("n"), F.array_join(T.tokens("text"), " ").alias("tokens"))


@query(with_archive("SELECT doc_id, pos, CASE WHEN length(w) <= 2 THEN 0 WHEN length(w) <= 5 THEN 1 ELSE 2 END AS edits FROM (SELECT doc_id, pos, string_split(line, ' ')[1] AS w FROM lines)"))
def h05_max_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).select("doc_id", "pos", T.max_edits(F.element_at(F.split("line", " "), 1)).alias("edits"))


@query("SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> ''))::BIGINT AS n_words FROM documents")
def h09_word_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.word_count("text").alias("n_words"))


@query("""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '') AS w FROM documents),
s AS (SELECT doc_id, w, unnest(range(0, len(w), 220)) AS i FROM w)
SELECT doc_id, i::BIGINT AS start, array_to_string(w[i + 1 : i + 250], ' ') AS chunk FROM s""")
def h11_sliding_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 250 words in steps of 220."""
    split = table(spark, sf_dir, "documents").select("doc_id", T.words("text").alias("words"))
    windows = split.select("doc_id", F.posexplode(T.sliding_words(F.col("words"))).alias("i", "chunk"))
    return windows.select("doc_id", (F.col("i") * 220).cast("long").alias("start"), "chunk")


@query("SELECT c_custkey, 'Name: ' || c_name || '. Segment: ' || c_mktsegment || '.' AS chunk FROM customer")
def h14_metadata_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled values in a fixed order; missing ones are left out."""
    fields = {"Name": "c_name", "Segment": "c_mktsegment"}
    parts = [F.when(F.trim(c) != "", F.concat(F.lit(f"{label}: "), F.col(c), F.lit("."))) for label, c in fields.items()]
    return table(spark, sf_dir, "customer").select("c_custkey", F.concat_ws(" ", *parts).alias("chunk"))


@query("SELECT doc_id, trim(regexp_replace(text, '[\\s ]+', ' ', 'g')) AS line FROM documents")
def h15_single_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.squeeze("text").alias("line"))


@query(with_archive(f"SELECT doc_id, array_to_string(list_transform({sql_tokens('subject')}, lambda t: left(t, 1)), '') AS acronym FROM docs"))
def h40_acronym(spark: SparkSession, sf_dir: str) -> DataFrame:
    subject = F.element_at(F.split("text", "\n"), 1)
    return table(spark, sf_dir, "documents").select("doc_id", T.acronym(subject).alias("acronym"))


@query("""SELECT doc_id, CASE WHEN length(regexp_replace(text, '\\P{L}', '', 'g')) > 0 THEN length(regexp_replace(text, '\\P{Lu}', '', 'g'))::DOUBLE / length(regexp_replace(text, '\\P{L}', '', 'g')) ELSE 0.0 END AS ratio FROM documents""")
def h41_uppercase_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.uppercase_ratio("text").alias("ratio"))


@query("SELECT page_id, trim(regexp_replace(regexp_replace(url, '[\\\\/:*?\"<>|]+', '_', 'g'), '\\s+', ' ', 'g')) AS name FROM pages")
def h38_safe_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.safe_name("url").alias("name"))


@query("SELECT page_id, regexp_replace(replace(url, '.html', '_ocr.html'), '_ocr(\\.[^.]*)$', '\\1') AS name FROM pages")
def h37_strip_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_replace(F.replace("url", F.lit(".html"), F.lit("_ocr.html")), r"_ocr(\.[^.]*)$", "$1").alias("name"))


@query(with_archive(f"SELECT doc_id, pos, regexp_replace({sql_fold('line')}, '[0-9]', '#', 'g') AS signature FROM lines WHERE contains(line, ' | ')"))
def h51_row_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folded cells with digits masked."""
    return lines(spark, sf_dir).where(F.contains("line", F.lit(" | "))).select("doc_id", "pos", F.regexp_replace(T.fold("line"), "[0-9]", "#").alias("signature"))


@query(with_archive(f"SELECT doc_id, pos, regexp_replace({sql_fold('line')}, '[^a-z0-9]', '', 'g') AS base FROM lines"))
def h43_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).select("doc_id", "pos", F.regexp_replace(T.fold("line"), "[^a-z0-9]", "").alias("base"))


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'Quyết định' WHEN 1 THEN 'Hợp đồng' WHEN 2 THEN 'Dự án' END AS doc_type FROM orders""")
def h23_type_of_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number symbols of four layouts; codes that fold alike go to the later type."""
    turn, n = F.col("o_orderkey") % 4, F.col("o_orderkey").cast("string")
    symbol = F.when(turn == 0, F.concat(F.lit("Số: "), n, F.lit("/QĐ-UBND"))).when(turn == 1, F.concat(n, F.lit("-HD/X"))).when(turn == 2, F.concat(n, F.lit("/ĐA-Y"))).otherwise(F.concat(n, F.lit("/XYZ-Q")))
    return table(spark, sf_dir, "orders").select("o_orderkey", T.document_type_of_number(symbol).alias("doc_type"))


@query("""SELECT c.conv_id, c.turn, levenshtein(a, b)::DOUBLE / greatest(length(a), 1) AS cer, greatest(0.0, 1.0 - levenshtein(a, b)::DOUBLE / greatest(length(a), 1)) AS accuracy
FROM (SELECT x.conv_id, x.turn, regexp_replace(strip_accents(x.text), '[^ -~]', '', 'g') AS a, regexp_replace(strip_accents(y.text), '[^ -~]', '', 'g') AS b FROM conversations x JOIN conversations y ON y.conv_id = x.conv_id AND y.turn = x.turn + 1) c""")
def d31_character_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edit distance over the reference's length, for each turn and the one after it."""
    plain = F.regexp_replace(T.strip_accents("text"), "[^ -~]", "")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", plain.alias("a"))
    following = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("a").alias("b"))
    cer = F.levenshtein("a", "b") / F.greatest(F.length("a"), F.lit(1))
    return turns.join(following, ["conv_id", "turn"]).select("conv_id", "turn", cer.alias("cer"), F.greatest(F.lit(0.0), 1.0 - cer).alias("accuracy"))


@query("SELECT page_id, substr(sha1(url), 1, 16) AS stable_id FROM pages")
def i12_stable_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", H.stable_id("url").alias("stable_id"))


@query("SELECT doc_id, CASE WHEN r < 0.8 THEN 'train' WHEN r < 0.9 THEN 'val' ELSE 'test' END AS split FROM (SELECT doc_id, ('0x' || substr(sha1('42:' || doc_id), 1, 12))::BIGINT / 281474976710655.0::DOUBLE AS r FROM documents)")
def i14_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By the first 12 digits of a seeded SHA-1; training first."""
    return table(spark, sf_dir, "documents").select("doc_id", H.seeded_split(F.col("doc_id").cast("string"), "42").alias("split"))


@query("SELECT doc_id, CASE WHEN r < 0.1 THEN 'test' WHEN r < 0.2 THEN 'val' ELSE 'train' END AS split FROM (SELECT doc_id, ('0x' || substr(sha1(doc_id::VARCHAR), 1, 8))::BIGINT / 4294967295.0::DOUBLE AS r FROM documents)")
def i15_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By the first 8 digits of SHA-1; tests first."""
    return table(spark, sf_dir, "documents").select("doc_id", H.plain_split(F.col("doc_id").cast("string")).alias("split"))


@query("SELECT doc_id, CASE WHEN r < 800 THEN 'train' WHEN r < 900 THEN 'val' ELSE 'test' END AS split FROM (SELECT doc_id, ('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT % 1000 AS r FROM documents)")
def i16_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By the first 8 digits of MD5, modulo 1000."""
    return table(spark, sf_dir, "documents").select("doc_id", H.modulo_split(F.col("doc_id").cast("string")).alias("split"))


_BOXES = """(SELECT a.doc_id, a.pos AS a_pos, b.pos AS b_pos, a.x0 AS ax0, a.y0 AS ay0, a.x1 AS ax1, a.y1 AS ay1, b.x0 + 30 AS bx0, b.y0 - 5 AS by0, b.x1 + 30 AS bx1, b.y1 - 5 AS by1 FROM lines a JOIN lines b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1)"""
_CUT = "greatest(0.0, least(ax1, bx1) - greatest(ax0, bx0)) * greatest(0.0, least(ay1, by1) - greatest(ay0, by0))"


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = lines(spark, sf_dir)
    a = own.select("doc_id", F.col("pos").alias("a_pos"), *[F.col(s).alias(f"a{s}") for s in G.SIDES])
    b = own.select("doc_id", F.col("pos").alias("b_pos"), (F.col("pos") - 1).alias("a_pos"), (F.col("x0") + 30).alias("bx0"), (F.col("y0") - 5).alias("by0"), (F.col("x1") + 30).alias("bx1"), (F.col("y1") - 5).alias("by1"))
    return a.join(b, ["doc_id", "a_pos"])


@query(with_archive(f"SELECT doc_id, a_pos, round(CASE WHEN u > 0 THEN c / u ELSE 0 END, 9) AS iou FROM (SELECT *, {_CUT} AS c, greatest(0.0, ax1 - ax0) * greatest(0.0, ay1 - ay0) + greatest(0.0, bx1 - bx0) * greatest(0.0, by1 - by0) - {_CUT} AS u FROM {_BOXES})"))
def i01_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("doc_id", "a_pos", F.round(G.iou("a", "b"), 9).alias("iou"))


@query(with_archive(f"SELECT doc_id, a_pos, {_CUT} AS common FROM {_BOXES}"))
def i02_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("doc_id", "a_pos", G.intersection("a", "b").alias("common"))


@query(with_archive(f"SELECT doc_id, a_pos, round(CASE WHEN (ax1 - ax0) * (ay1 - ay0) > 0 THEN {_CUT} / ((ax1 - ax0) * (ay1 - ay0)) ELSE 0 END, 9) AS share FROM {_BOXES}"))
def i03_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("doc_id", "a_pos", F.round(G.coverage("a", "b"), 9).alias("share"))


@query(with_archive("SELECT doc_id, pos, least(1000, greatest(0, round_even(x1 / 595.0::DOUBLE * 1000, 0)::INT)) AS nx, least(1000, greatest(0, round_even(y1 / 842.0::DOUBLE * 1000, 0)::INT)) AS ny FROM lines"))
def i04_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).select("doc_id", "pos", G.normalized(F.col("x1"), F.lit(595.0)).alias("nx"), G.normalized(F.col("y1"), F.lit(842.0)).alias("ny"))


@query(with_archive("SELECT doc_id, a_pos, round(CASE WHEN least(ax1 - ax0, bx1 - bx0) > 0 THEN greatest(0.0, least(ax1, bx1) - greatest(ax0, bx0)) / least(ax1 - ax0, bx1 - bx0) ELSE 0 END, 9) AS overlap FROM " + _BOXES))
def i06_x_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("doc_id", "a_pos", F.round(G.x_overlap("a", "b"), 9).alias("overlap"))


@query("SELECT event_id, round_even(least(1.0, greatest(0.0, (value - 5.0) / 45.0)) * 15, 0)::INT AS bucket FROM events")
def i07_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", G.bucket(F.col("value"), 5.0, 50.0, 16).alias("bucket"))


@query("SELECT event_id, least(1.0, greatest(0.0, value / 40.0)) AS share FROM events")
def i19_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", G.clamp01(F.col("value") / 40.0).alias("share"))


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS norm, round(embedding[1]::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS first FROM embeddings")
def i17_normalized_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return e.select("vec_id", F.round(norm, 6).alias("norm"), F.round(F.element_at("embedding", 1).cast("double") / norm, 6).alias("first"))



@query("SELECT doc_id, CASE WHEN doc_id % 20 < 6 THEN (['find ', 'look for ', 'documents on ', 'search ', 'where is ', 'show '])[doc_id % 20 + 1] || s ELSE s END AS query FROM (SELECT doc_id, string_split(text, chr(10))[1] AS s FROM documents)")
def m08_query_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six templates in turn, for six of each twenty queries."""
    prefixes = F.array(*map(F.lit, ("find ", "look for ", "documents on ", "search ", "where is ", "show ")))
    turn, head = (F.col("doc_id") % 20).cast("int"), F.element_at(F.split("text", "\n"), 1)
    return table(spark, sf_dir, "documents").select("doc_id", F.when(turn < 6, F.concat(F.get(prefixes, turn), head)).otherwise(head).alias("query"))


@query("SELECT doc_id, regexp_replace('Search for ' || text, '^(?i)(search for|find|look for)\\s+', '') AS query FROM documents")
def m09_strip_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace(F.concat(F.lit("Search for "), "text"), r"^(?i)(search for|find|look for)\s+", "").alias("query"))
