"""Rule queries: line recognisers, document numbers, packing, votes, cells, page selection, state changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..operators import measures as M
from ..operators import merge
from ..operators import spans as S
from .bindings import documents, lines, sql_fold, table, with_archive
from .registry import query





@query("SELECT conv_id, turn, CASE WHEN contains(t, 'the') AND contains(t, 'and') THEN 'party' WHEN contains(t, 'the') THEN 'state' ELSE 'other' END AS kind FROM (SELECT conv_id, turn, " + sql_fold("text") + " AS t FROM conversations)")
def h29_header_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = T.fold("text")
    has = lambda w: F.contains(t, F.lit(w))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(has("the") & has("and"), "party").when(has("the"), "state").otherwise("other").alias("kind"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN upper(trim(c_mktsegment)) ELSE trim(regexp_replace('  ' || c_name || '  x', '\\s+', ' ', 'g')) END AS value FROM customer")
def h30_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marks in capitals, other values squeezed."""
    return table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.upper(F.trim("c_mktsegment"))).otherwise(T.squeeze(F.concat(F.lit("  "), "c_name", F.lit("  x")))).alias("value"))


@query("SELECT page_id, trim(regexp_replace(translate(url, '+-&|!(){}[]^\"~*?:\\/', '                   '), ' +', ' ', 'g')) AS query FROM pages")
def h39_escaped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query operators become spaces."""
    return table(spark, sf_dir, "pages").select("page_id", F.trim(F.regexp_replace(F.translate("url", '+-&|!(){}[]^"~*?:\\/', " " * 19), " +", " ")).alias("query"))


@query(with_archive(f"SELECT doc_id, CASE WHEN contains(t, 'of the') THEN 3 WHEN contains(t, 'of') THEN 2 WHEN contains(t, 'the') THEN 1 ELSE 0 END AS score FROM (SELECT doc_id, {sql_fold('subject')} AS t FROM docs)"))
def h50_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of a name, its last two words, or its last."""
    t = T.fold("subject")
    return documents(spark, sf_dir).select("doc_id", F.when(F.contains(t, F.lit("of the")), 3).when(F.contains(t, F.lit("of")), 2).when(F.contains(t, F.lit("the")), 1).otherwise(0).alias("score"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey::VARCHAR || '-' || o_orderstatus ELSE o_orderstatus END AS symbol FROM orders")
def h53_symbol(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number and symbol joined; a missing number is left out."""
    number = F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderkey").cast("string")).otherwise("")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.concat_ws("-", F.nullif(number, F.lit("")), "o_orderstatus").alias("symbol"))


@query("SELECT doc_id, ('0x' || substr(sha1('7:' || doc_id), 1, 12))::BIGINT / 281474976710655.0::DOUBLE AS ratio FROM documents")
def i13_hash_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = F.sha1(F.concat(F.lit("7:"), F.col("doc_id").cast("string")))
    return table(spark, sf_dir, "documents").select("doc_id", (F.conv(F.substring(digest, 1, 12), 16, 10).cast("long") / F.lit(float(16**12 - 1))).alias("ratio"))


@query(with_archive("SELECT doc_id, pos, least(1000, greatest(0, round_even(x1 / 595.0::DOUBLE * 1000, 0)::INT)) / 1000.0::DOUBLE * 595.0::DOUBLE AS x FROM lines"))
def i05_denormalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions import geometry as G

    return lines(spark, sf_dir).select("doc_id", "pos", (G.normalized(F.col("x1"), F.lit(595.0)) / 1000.0 * 595.0).alias("x"))


@query(with_archive("SELECT doc_id, pos, (least(3, length(line) // 30) * 16 + pos % 16)::INT AS style FROM lines"))
def i10_style_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buckets of two attributes in one id."""
    return lines(spark, sf_dir).select("doc_id", "pos", (F.least(F.lit(3), F.floor(F.length("line") / 30)) * 16 + F.col("pos") % 16).cast("int").alias("style"))


_VOTES = "(SELECT conv_id, turn, (CASE WHEN contains(text, 'the') THEN 5 ELSE 0 END + CASE WHEN contains(text, 'and') THEN 3 ELSE 0 END + CASE WHEN contains(text, 'of') THEN 2 ELSE 0 END + CASE WHEN turn >= max(turn) OVER (PARTITION BY conv_id) - 1 THEN 1 ELSE 0 END)::INT AS score FROM conversations)"


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = sum((F.when(F.contains("text", F.lit(w)), n).otherwise(0) for w, n in (("the", 5), ("and", 3), ("of", 2))), F.lit(0))
    end = F.when(F.col("turn") >= F.max("turn").over(Window.partitionBy("conv_id")) - 1, 1).otherwise(0)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", (points + end).alias("score"))





@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, g ORDER BY value DESC, event_id) AS r FROM (SELECT *, sum(far) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM (SELECT *, coalesce((ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > INTERVAL 1 HOUR)::INT, 1) AS far FROM events))) WHERE r = 1")
def e12_merged_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows near each other are one; of each the best stays."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.col("ts").cast("timestamp").cast("double") - F.lag(F.col("ts").cast("timestamp").cast("double")).over(w)
    e = table(spark, sf_dir, "events").withColumn("far", F.coalesce(gap > 3600, F.lit(True)))
    ordered = e.withColumn("o", F.struct("ts", "event_id"))
    return M.top_k(S.islands(ordered, ["user_id"], "o", F.col("far")), ["user_id", "island"], [F.col("value").desc(), F.col("event_id")], 1).select("user_id", "event_id")



@query("SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC, event_id) AS d FROM (SELECT * FROM events WHERE value >= 5 ORDER BY value DESC, event_id LIMIT 300)) WHERE d = 1 ORDER BY value DESC, event_id LIMIT 100")
def f02_fuzzy_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report: the best 300 above a score, each kind once, the best 100 of them."""
    best = table(spark, sf_dir, "events").where("value >= 5").orderBy(F.col("value").desc(), "event_id").limit(300)
    return M.top_k(best, ["user_id", "event_type"], [F.col("value").desc(), F.col("event_id")], 1).orderBy(F.col("value").desc(), "event_id").limit(100).select("event_id", "user_id")





@query("SELECT event_id, coalesce(json_extract_string(props, '$.k')::BIGINT, 0) AS k, 1 AS version, 'none' AS engine FROM events")
def g26_upgraded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Defaults for what a nested record lacks."""
    record = F.from_json("props", "k long, version int, engine string")
    filled = record.withField("k", F.coalesce(record["k"], F.lit(0))).withField("version", F.coalesce(record["version"], F.lit(1))).withField("engine", F.coalesce(record["engine"], F.lit("none")))
    return table(spark, sf_dir, "events").select("event_id", filled.alias("r")).select("event_id", "r.k", "r.version", "r.engine")





@query(with_archive("SELECT doc_id, pos, least(x1, 300.0) - greatest(x0, 10.0) > 0 AND least(y1, 200.0) - greatest(y0, 0.0) > 0 AS inside FROM lines"))
def b21_intersects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strict overlap with a region."""
    hit = (F.least("x1", F.lit(300.0)) > F.greatest("x0", F.lit(10.0))) & (F.least("y1", F.lit(200.0)) > F.greatest("y0", F.lit(0.0)))
    return lines(spark, sf_dir).select("doc_id", "pos", hit.alias("inside"))


@query(with_archive(f"SELECT DISTINCT fonds, contains({sql_fold('fonds')}, 'e') OR starts_with({sql_fold('fonds')}, 'fr') AS accepted FROM docs"))
def b23_option_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Options by substring or by the start of their acronym."""
    f = T.fold("fonds")
    return documents(spark, sf_dir).select("fonds", (F.contains(f, F.lit("e")) | F.startswith(f, F.lit("fr"))).alias("accepted")).distinct()


@query("SELECT doc_id, length(text) >= 40 AND length(regexp_replace(text, '[^*#%$&|]', '', 'g')) >= greatest(8, 0.025::DOUBLE * length(text)) AS broken FROM documents")
def b25_broken_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with too many odd characters."""
    odd = F.length(F.regexp_replace("text", r"[^*#%$&|]", ""))
    return table(spark, sf_dir, "documents").select("doc_id", ((F.length("text") >= 40) & (odd >= F.greatest(F.lit(8), 0.025 * F.length("text")))).alias("broken"))


@query(with_archive(f"SELECT doc_id, pos, regexp_matches({sql_fold('line')}, '\\bngay\\s+[0-9]{{1,2}}\\s+thang|[0-9]{{1,2}}[/.-][0-9]{{1,2}}[/.-][0-9]{{2,4}}') AS dated FROM lines"))
def b28_date_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).select("doc_id", "pos", T.fold("line").rlike(r"\bngay\s+[0-9]{1,2}\s+thang|[0-9]{1,2}[/.-][0-9]{1,2}[/.-][0-9]{2,4}").alias("dated"))


@query(with_archive(f"SELECT doc_id, pos, starts_with({sql_fold('line')}, 'the ') OR starts_with({sql_fold('line')}, 'of ') AS body FROM lines"))
def b29_body_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = T.fold("line")
    return lines(spark, sf_dir).select("doc_id", "pos", (F.startswith(t, F.lit("the ")) | F.startswith(t, F.lit("of "))).alias("body"))



@query(with_archive("SELECT doc_id FROM docs WHERE status <> 'deleted' AND doc_id NOT IN (SELECT doc_id FROM docs WHERE dossier_id = 'src3')"))
def k05_delete_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir)
    return merge.deleted(d.where("status <> 'deleted'"), d.where("dossier_id = 'src3'").select("doc_id"), ["doc_id"]).select("doc_id")


@query("SELECT count(*)::BIGINT AS errors FROM lineitem WHERE l_discount < 0 OR l_discount > 0.1 OR l_quantity < 1")
def k15_no_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").where("l_discount < 0 or l_discount > 0.1 or l_quantity < 1").agg(F.count(F.lit(1)).alias("errors"))



@query("SELECT conv_id, string_agg(role, ' ' ORDER BY turn) AS tokens, string_agg((length(text) % 3)::VARCHAR, ' ' ORDER BY turn) AS labels FROM conversations GROUP BY conv_id")
def m05_training_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parallel sequences of a page's tokens and labels."""
    row = F.array_sort(F.collect_list(F.struct("turn", "role", (F.length("text") % 3).cast("string").alias("label"))))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(row.alias("x")).select("conv_id", F.array_join("x.role", " ").alias("tokens"), F.array_join("x.label", " ").alias("labels"))
