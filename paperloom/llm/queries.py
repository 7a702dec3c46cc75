"""The thin queries over the operators, with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, cws, decontaminate, lines, maxent, quality, secrets, simhash, urls, warc
from .common import table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.read_archives(spark, warc.write_archives(table(spark, sf_dir, "pages")), payloads=False)
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.simhash_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_weighted_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cws.fingerprints(table(spark, sf_dir, "documents"))


def op5_secret_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scanned(table(spark, sf_dir, "documents"))


def op6_quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = lines.deduplicated(table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "n_removed", F.length("text").cast("long").alias("n_chars_left"), F.sha2("text", 256).alias("text_sha256"))


def op8_bpe_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(table(spark, sf_dir, "documents"), tokenizer_path())


def op9_url_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judged(table(spark, sf_dir, "pages"))


def op10_maxent_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent.scored(table(spark, sf_dir, "documents"))


OP2_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
k AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS payload_digest, max(page_id) OVER (PARTITION BY html) AS top FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id < top THEN top END AS refers_to
FROM k
"""

OP7_SQL = f"""
WITH d AS (SELECT doc_id, text, coalesce(source, '') AS site, string_split(text, chr(10)) AS parts FROM documents),
l AS (SELECT doc_id, site, unnest(range(len(parts))) AS pos, trim(unnest(parts)) AS line FROM d),
b AS (SELECT line, min((doc_id, pos)) AS first FROM l WHERE line <> '' GROUP BY line HAVING count(DISTINCT site) >= {lines.MIN_SITES}),
k AS (SELECT l.doc_id, l.pos, b.line IS NOT NULL AND (l.doc_id, l.pos) <> b.first AS gone FROM l LEFT JOIN b ON b.line = l.line),
t AS (SELECT d.doc_id, sum(k.gone::INT)::BIGINT AS n_removed, coalesce(string_agg(d.parts[k.pos + 1], chr(10) ORDER BY k.pos) FILTER (WHERE NOT k.gone), '') AS text
      FROM d JOIN k ON k.doc_id = d.doc_id GROUP BY d.doc_id)
SELECT doc_id, n_removed, length(text)::BIGINT AS n_chars_left, sha256(text) AS text_sha256 FROM t
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op")}


def oracle_sql() -> dict[str, str]:
    return {"op2_warc_round_trip": OP2_SQL, "op7_line_dedup": OP7_SQL}
