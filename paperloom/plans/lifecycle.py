"""Imports, nested documents, corrections, candidate features and aggregates of whole runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import repair
from ..functions import text as T
from ..operators import measures as M
from ..operators import merge
from .bindings import documents, lines, sql_tokens, table, with_archive
from .registry import query


@query(with_archive("SELECT doc_id, file_name FROM docs WHERE fonds = 'en' AND dossier_id IN ('src1', 'src2')"))
def a20_by_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).where("fonds = 'en' and dossier_id in ('src1', 'src2')").select("doc_id", "file_name")





@query(with_archive("SELECT doc_id, pos, regexp_matches(line, '[0-9]') OR regexp_matches(line, '[/_\\\\-]') OR regexp_matches(line, '^[A-Z]{2,6}$') AS code FROM lines"))
def b27_code_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("line")
    return lines(spark, sf_dir).select("doc_id", "pos", (x.rlike("[0-9]") | x.rlike(r"[/_\\-]") | x.rlike("^[A-Z]{2,6}$")).alias("code"))


@query("SELECT p_partkey, CASE p_size % 4 WHEN 2 THEN p_retailprice >= 4 WHEN 3 THEN p_retailprice >= 900 ELSE p_size > 10 END AS admitted FROM part")
def b26_admitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thresholds by the kind of candidate."""
    n = F.col("p_size") % 4
    return table(spark, sf_dir, "part").select("p_partkey", F.when(n == 2, F.col("p_retailprice") >= 4).when(n == 3, F.col("p_retailprice") >= 900).otherwise(F.col("p_size") > 10).alias("admitted"))


@query(with_archive("SELECT doc_id, pos, x1 >= 50 - 0.1::DOUBLE * 300 AND x0 <= 350 + 0.1::DOUBLE * 300 AND y1 >= 100 - 0.1::DOUBLE * 100 AND y0 <= 200 + 0.1::DOUBLE * 100 AS near FROM lines"))
def b22_near_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed overlap with a region that is widened by a margin."""
    near = (F.col("x1") >= 50 - 0.1 * 300) & (F.col("x0") <= 350 + 0.1 * 300) & (F.col("y1") >= 100 - 0.1 * 100) & (F.col("y0") <= 200 + 0.1 * 100)
    return lines(spark, sf_dir).select("doc_id", "pos", near.alias("near"))


@query("SELECT user_id, max((r <= 1 AND hit)::INT) AS top1, max((r <= 2 AND hit)::INT) AS top2 FROM (SELECT user_id, event_type = 'click' AS hit, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS r FROM events) GROUP BY user_id")
def d13_task_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = M.top_k(table(spark, sf_dir, "events"), ["user_id"], [F.col("value").desc(), F.col("event_id")], 2)
    hit = F.col("event_type") == "click"
    return best.groupBy("user_id").agg(F.max((hit & (F.col("rank") == 1)).cast("int")).alias("top1"), F.max(hit.cast("int")).alias("top2"))


@query("SELECT lang, round(0.6::DOUBLE * avg((n_chars > 500)::INT) + 0.3::DOUBLE * avg((n_chars > 1500)::INT) - 0.1::DOUBLE * avg((n_chars > 9000)::INT), 9) AS objective FROM documents GROUP BY lang")
def d17_objective(spark: SparkSession, sf_dir: str) -> DataFrame:
    share = lambda n: F.avg((F.col("n_chars") > n).cast("int"))
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.round(0.6 * share(500) + 0.3 * share(1500) - 0.1 * share(9000), 9).alias("objective"))


_LISTS = "(SELECT s, row_number() OVER (PARTITION BY s ORDER BY k) AS i, n FROM (SELECT l_suppkey AS s, l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY 1, 2))"


@query(f"SELECT coalesce(a.s, b.s) AS s, round(avg(CASE WHEN a.n IS NULL OR b.n IS NULL THEN 0 ELSE least(a.n, b.n) / greatest(a.n, b.n)::DOUBLE END), 9) AS score FROM {_LISTS} a FULL JOIN {_LISTS} b ON a.s = b.s AND a.i = b.i + 2 GROUP BY 1")
def d29_padded_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two lists side by side for each group, the shorter filled with nothing."""
    n = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("s"), "l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    a = n.select("s", F.row_number().over(Window.partitionBy("s").orderBy("l_orderkey")).alias("i"), F.col("n").alias("x"))
    b = a.select("s", (F.col("i") + 2).alias("i"), F.col("x").alias("y"))
    score = F.coalesce(F.least("x", "y") / F.greatest("x", "y") * F.when(F.col("x").isNotNull() & F.col("y").isNotNull(), 1.0), F.lit(0.0))
    return a.join(b, ["s", "i"], "full").groupBy("s").agg(F.round(F.avg(score), 9).alias("score"))



@query("SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events")
def g27_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested fields dropped."""
    record = F.from_json("props", "k long, extra string")
    return table(spark, sf_dir, "events").select("event_id", record.dropFields("extra").alias("r")).select("event_id", "r.k")



@query("SELECT c_custkey, c_name || ', ' || c_mktsegment || ' - x' AS text FROM customer")
def h21_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit("<td> "), "c_name", F.lit("&nbsp;, <b>"), "c_mktsegment", F.lit("</b>– x</td>"))
    spaced = F.replace(raw, F.lit("–"), F.lit(" –"))
    return table(spark, sf_dir, "customer").select("c_custkey", repair.normalize_cell(spaced).alias("text"))


@query()
def h48_word_replacements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words changed between a turn and its text with some letters changed."""
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", F.size(repair.word_replacements("text", F.regexp_replace("text", r"\bthe\b", "thé"))).alias("n"))


@query()
def h49_fuzzy_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", repair.word_set_score("text", F.lit("the and of in")).alias("score"))


@query(f"SELECT token, count(*)::BIGINT AS tf, count(DISTINCT conv_id)::BIGINT AS df FROM (SELECT conv_id, unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) AS token FROM (SELECT conv_id, {sql_tokens('text')} AS t FROM conversations)) GROUP BY token")
def h45_ngram_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of neighbouring tokens, with their counts and those of their documents."""
    pairs = F.when(F.size("t") > 1, F.transform(F.sequence(F.lit(1), F.size("t") - 1), lambda i: F.concat_ws(" ", F.element_at("t", i), F.element_at("t", i + 1)))).otherwise(F.array().cast("array<string>"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", T.tokens("text").alias("t")).select("conv_id", F.explode(pairs).alias("token"))
    each = rows.groupBy("token", "conv_id").agg(F.count(F.lit(1)).alias("n"))
    return each.groupBy("token").agg(F.sum("n").alias("tf"), F.count(F.lit(1)).alias("df"))


@query("SELECT conv_id, turn, length(text)::BIGINT AS chars, len(string_split(text, ' '))::BIGINT AS words, turn / greatest(1, max(turn) OVER (PARTITION BY conv_id))::DOUBLE AS place, (role = 'user')::INT AS is_user FROM conversations")
def i31_candidate_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = F.greatest(F.lit(1), F.max("turn").over(Window.partitionBy("conv_id")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").cast("long").alias("chars"), F.size(F.split("text", " ")).cast("long").alias("words"), (F.col("turn") / last).alias("place"), (F.col("role") == "user").cast("int").alias("is_user"))



@query(with_archive(f"SELECT doc_id, field, token, count(*)::BIGINT AS tf FROM (SELECT doc_id, 'subject' AS field, unnest({sql_tokens('subject')}) AS token FROM docs UNION ALL SELECT doc_id, 'file', unnest({sql_tokens('file_name')}) FROM docs) GROUP BY ALL"))
def j01_field_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings of several fields."""
    d = documents(spark, sf_dir)
    part = lambda name, c: d.select("doc_id", F.lit(name).alias("field"), F.explode(T.tokens(c)).alias("token"))
    return part("subject", "subject").unionByName(part("file", "file_name")).groupBy("doc_id", "field", "token").agg(F.count(F.lit(1)).alias("tf"))


@query("SELECT o_orderstatus, count(*)::BIGINT AS taken, count(*) FILTER (WHERE o_orderpriority IS NULL OR o_totalprice < 0)::BIGINT AS failed FROM orders GROUP BY o_orderstatus")
def k01_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch with its failures set apart."""
    bad = F.col("o_orderpriority").isNull() | (F.col("o_totalprice") < 0)
    return table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("taken"), F.count_if(bad).alias("failed"))


@query("SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey IN (1, 2, 3))")
def k08_bulk_dossiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = table(spark, sf_dir, "customer").where("c_nationkey in (1, 2, 3)").select(F.col("c_custkey").alias("o_custkey"))
    return merge.deleted(table(spark, sf_dir, "orders"), gone, ["o_custkey"]).select("o_orderkey")


@query("SELECT user_id, string_agg(event_type, ',' ORDER BY event_type) AS kinds FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY user_id")
def k16_injected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreed values written into nested records."""
    kinds = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("kinds"))
    nested = kinds.select("user_id", F.struct(F.lit(1).alias("version")).withField("kinds", F.col("kinds")).alias("doc"))
    return nested.select("user_id", F.array_join("doc.kinds", ",").alias("kinds"))


@query("SELECT c_nationkey, count(o_orderkey)::BIGINT AS n, coalesce(round(sum(o_totalprice), 2), 0)::DOUBLE AS total FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_nationkey")
def l09_aggregated_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of all documents and a dossier row."""
    both = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left")
    return both.groupBy("c_nationkey").agg(F.count("o_orderkey").alias("n"), F.coalesce(F.round(F.sum("o_totalprice"), 2), F.lit(0.0)).alias("total"))



@query(with_archive("SELECT doc_id, page, string_agg(split_part(line, ' ', 1), ' ' ORDER BY pos) AS tokens, string_agg(CASE WHEN contains(line, 'the') THEN 'B-X' ELSE 'O' END, ' ' ORDER BY pos) AS tags FROM lines GROUP BY doc_id, page"))
def m01_token_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's tokens and tags as parallel sequences."""
    own = F.array_sort(F.collect_list(F.struct("pos", F.element_at(F.split("line", " "), 1).alias("t"), F.when(F.contains("line", F.lit("the")), "B-X").otherwise("O").alias("g"))))
    return lines(spark, sf_dir).groupBy("doc_id", "page").agg(own.alias("x")).select("doc_id", "page", F.array_join("x.t", " ").alias("tokens"), F.array_join("x.g", " ").alias("tags"))
