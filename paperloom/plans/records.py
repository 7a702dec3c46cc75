"""Records, spans and scalar rules: what remains of the inventory in relational form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import fuzzy
from ..functions import text as T
from ..operators import greedy, merge
from ..operators import measures as M
from ..operators import search as S
from ..operators import spans
from .bindings import documents, lines, sql_fold, sql_tokens, table, with_archive
from .measures import _TAGS, _tags
from .registry import query


@query("SELECT user_id AS k, event_type AS v FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY src DESC, event_id DESC) AS r FROM (SELECT user_id, event_type, event_id, 0 AS src FROM events UNION ALL SELECT user_id, 'set', event_id, 1 FROM events WHERE value > 30)) WHERE r = 1")
def a06_batch_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many keys set at once."""
    e = table(spark, sf_dir, "events")
    old, new = e.select("user_id", "event_type", "event_id", F.lit(0).alias("src")), e.where("value > 30").select("user_id", F.lit("set").alias("event_type"), "event_id", F.lit(1).alias("src"))
    return merge.latest(old.unionByName(new), ["user_id"], [F.col("src").desc(), F.col("event_id").desc()]).select(F.col("user_id").alias("k"), F.col("event_type").alias("v"))


@query("SELECT item_id, text FROM benchmark")
def a16_json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records written as JSON lines and read by an explicit schema."""
    lines_of = table(spark, sf_dir, "benchmark").select(F.to_json(F.struct("item_id", "text")).alias("line"))
    return lines_of.select(F.from_json("line", "item_id long, text string", {"mode": "PERMISSIVE"}).alias("r")).select("r.*")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey = 7")
def a21_entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").where("c_custkey = 7").select("c_custkey", "c_name")


@query("SELECT l_orderkey, string_agg(DISTINCT l_partkey::VARCHAR, ',' ORDER BY l_partkey::VARCHAR) AS parts FROM lineitem WHERE l_quantity > 25 GROUP BY l_orderkey")
def a22_relevance_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The set of each query's positives."""
    rows = table(spark, sf_dir, "lineitem").where("l_quantity > 25")
    return rows.groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_set(F.col("l_partkey").cast("string"))), ",").alias("parts"))



@query(with_archive(f"SELECT doc_id, pos FROM lines WHERE NOT regexp_matches({sql_fold('line')}, '^(licensed|this work|the |in )')"))
def b20_not_boilerplate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).where(~T.fold("line").rlike("^(licensed|this work|the |in )")).select("doc_id", "pos")



@query("SELECT source, coalesce(tp / nullif(tp + fp, 0), 0)::DOUBLE AS p, coalesce(tp / nullif(tp + fn, 0), 0)::DOUBLE AS r, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)::DOUBLE AS f1 FROM (SELECT source, count(*) FILTER (WHERE n_chars > 900 AND lang = 'en') AS tp, count(*) FILTER (WHERE n_chars > 900 AND lang <> 'en') AS fp, count(*) FILTER (WHERE n_chars <= 900 AND lang = 'en') AS fn FROM documents GROUP BY source)")
def d20_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratios of counts, 0 where there is nothing to divide by."""
    c = M.confusion(table(spark, sf_dir, "documents"), F.col("lang") == "en", F.col("n_chars") > 900, ["source"])
    return c.select("source", F.col("precision").alias("p"), F.col("recall").alias("r"), "f1")


@query("SELECT event_type, round(quantile_cont(value, 0.99), 9) AS p99 FROM events GROUP BY event_type")
def d24_clipped_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A percentile with its order clipped to 0 .. 1."""
    q = min(1.0, max(0.0, 0.99))
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.round(F.percentile("value", F.lit(q)), 9).alias("p99"))


@query("SELECT event_type, median(value) AS mid FROM events WHERE value > 10 GROUP BY event_type")
def d25_finite_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The median of values that count; others become nothing."""
    kept = F.when((F.col("value") > 10) & ~F.isnan("value"), F.col("value"))
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.median(kept).alias("mid")).where("mid is not null")


@query("SELECT conv_id, turn, levenshtein(a, b)::DOUBLE / greatest(length(a), 1) AS cer FROM (SELECT x.conv_id, x.turn, trim(regexp_replace(lower(regexp_replace(strip_accents(x.text), '[^ -~]', '', 'g')), '\\s+', ' ', 'g')) AS a, trim(regexp_replace(lower(regexp_replace(strip_accents(y.text), '[^ -~]', '', 'g')), '\\s+', ' ', 'g')) AS b FROM conversations x JOIN conversations y ON y.conv_id = x.conv_id AND y.turn = x.turn + 1)")
def d33_normalised_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Character error after case and white space are made equal."""
    plain = F.trim(F.regexp_replace(F.lower(F.regexp_replace(T.strip_accents("text"), "[^ -~]", "")), r"\s+", " "))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", plain.alias("a"))
    following = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("a").alias("b"))
    return turns.join(following, ["conv_id", "turn"]).select("conv_id", "turn", (F.levenshtein("a", "b") / F.greatest(F.length("a"), F.lit(1))).alias("cer"))


@query()
def e15_non_overlapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans by score, without those that a better one overlaps."""
    own = lines(spark, sf_dir).select("doc_id", F.col("pos").cast("long").alias("pos"), (F.length("line") % 17).alias("score"), F.col("pos").cast("double").alias("a"), (F.col("pos") + 1 + F.length("line") % 3).cast("double").alias("b"))
    return greedy.suppressed_intervals(own, "doc_id", "pos", "score", 0.0)


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'R' ELSE o_orderstatus END AS o_orderstatus, o_totalprice FROM orders)")
def g04_document_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    new = o.where("o_orderkey % 3 = 0").withColumn("o_orderstatus", F.lit("R"))
    return merge.upsert(o, new, ["o_orderkey"], keep=["o_orderstatus"], overwrite=["o_totalprice"])


@query(f"SELECT doc, field, min(i) AS first, max(i) AS last FROM (SELECT *, sum(begins::INT) OVER (PARTITION BY doc ORDER BY i) AS island FROM (SELECT *, substr(tag, 3) AS field, tag <> 'O' AND (tag LIKE 'B-%' OR lag(substr(tag, 3), 1, '') OVER (PARTITION BY doc ORDER BY i) <> substr(tag, 3)) AS begins FROM {_TAGS})) WHERE tag <> 'O' GROUP BY doc, island, field")
def g12_field_instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Field instances of tags; an inside tag without a beginning begins one."""
    return spans.decoded_spans(_tags(spark, sf_dir), ["doc"], "i", "tag", "word", "score").select("doc", "field", "first", "last")



@query("SELECT c_custkey, damerau_levenshtein('building', lower(c_mktsegment)) <= 2 AS near FROM customer")
def h06_token_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens within the allowed edits."""
    return table(spark, sf_dir, "customer").select("c_custkey", fuzzy.tokens_match(F.lit("building"), F.lower("c_mktsegment")).alias("near"))


@query(with_archive(f"SELECT doc_id, pos, trim(regexp_replace(regexp_replace({sql_fold('line')}, '[^\\p{{L}}\\p{{N}}_\\s]+', ' ', 'g'), '\\s+', ' ', 'g')) AS norm FROM lines"))
def h08_noise_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).select("doc_id", "pos", F.trim(F.regexp_replace(F.regexp_replace(T.fold("line"), r"[^\p{L}\p{N}_\s]+", " "), r"(?U)\s+", " ")).alias("norm"))


@query(with_archive("SELECT doc_id, pos, coalesce(y0 - lag(y1) OVER w BETWEEN -0.2::DOUBLE * 12 AND 6 * 12, FALSE) AS joins FROM lines WINDOW w AS (PARTITION BY doc_id, page ORDER BY pos)"))
def h13_mergeable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines near enough below the one before, on the same page."""
    gap = F.col("y0") - F.lag("y1").over(Window.partitionBy("doc_id", "page").orderBy("pos"))
    return lines(spark, sf_dir).select("doc_id", "pos", F.coalesce(gap.between(-0.2 * 12, 6 * 12), F.lit(False)).alias("joins"))


@query("SELECT doc_id, trim(regexp_replace(string_split(text, chr(10))[1], '[\\s ]+', ' ', 'g')) AS subject FROM documents")
def h16_subject(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", T.squeeze("subject").alias("subject"))



@query("SELECT c_custkey, greatest(0.0, 1.0 - levenshtein(c_name, c_mktsegment) / greatest(length(c_name), 1)::DOUBLE) AS score FROM customer")
def h22_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    share = F.levenshtein("c_name", "c_mktsegment") / F.greatest(F.length("c_name"), F.lit(1))
    return table(spark, sf_dir, "customer").select("c_custkey", F.greatest(F.lit(0.0), 1.0 - share).alias("score"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'Báo cáo' ELSE 'Khác' END AS doc_type FROM orders")
def h25_document_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The code's type, else the fallback."""
    symbol = F.when(F.col("o_orderkey") % 2 == 0, F.lit("7/BC-UB")).otherwise(F.lit("7/ZZ"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.coalesce(T.document_type_of_number(symbol), F.lit("Khác")).alias("doc_type"))


@query(f"SELECT conv_id, role || ':' || turn || ':' || {sql_fold('text')} AS vote FROM conversations")
def h31_vote_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label, page and folded value."""
    return table(spark, sf_dir, "conversations").select("conv_id", F.concat_ws(":", "role", F.col("turn").cast("string"), T.fold("text")).alias("vote"))


@query(f"SELECT doc_id, trim(regexp_replace({sql_fold('text')}, '[\\s ]+', ' ', 'g')) AS folded FROM documents")
def h42_norm_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.squeeze(T.fold("text")).alias("folded"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%d/%m/%Y') AS parsed FROM orders")
def h33_place_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The date of a line with place and date."""
    key = T.date_key(F.expr("concat('Hà Nội, ngày ', day(o_orderdate), ' tháng ', month(o_orderdate), ' năm ', year(o_orderdate))"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.concat_ws("/", F.substring(key, 7, 2), F.substring(key, 5, 2), F.substring(key, 1, 4)).alias("parsed"))




@query(f"SELECT item_id, array_to_string(list_filter({sql_tokens('text')}, lambda t: length(t) >= 3 AND NOT regexp_matches(t, '^[0-9]+$')), ' ') AS tokens FROM benchmark")
def j07_query_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = F.filter(T.tokens("text"), lambda t: (F.length(t) >= 3) & ~t.rlike("^[0-9]+$"))
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(kept, " ").alias("tokens"))


@query()
def j09_fuzzy_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report of the best hundred fuzzy hits."""
    found = S.fuzzy_postings(S.postings(table(spark, sf_dir, "documents"), "doc_id", "text"), "doc_id", "versoin")
    return S.ranked(found, [F.col("score").desc(), F.col("doc_id")], 100)


@query(f"SELECT doc_id, pos, place::INT AS place FROM (SELECT doc_id, pos, t, unnest(range(len(t))) AS place FROM (SELECT doc_id, pos, {sql_tokens('line')} AS t FROM (SELECT doc_id, unnest(range(len(string_split(text, chr(10)))))::INT AS pos, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE trim(line, ' ') <> '')) WHERE t[place + 1] = 'of' AND t[place + 2] = 'the'")
def j11_phrase_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where in a line's words a phrase stands."""
    words = lines(spark, sf_dir).select("doc_id", "pos", T.tokens("line").alias("t")).where(F.size("t") > 1)
    at = F.filter(F.sequence(F.lit(0), F.size("t") - 2), lambda i: (F.element_at("t", i + 1) == "of") & (F.element_at("t", i + 2) == "the"))
    return words.select("doc_id", "pos", F.explode(at).alias("place"))


@query("SELECT source AS dossier, min(doc_id) AS doc_id, sha256(text) AS sha FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) GROUP BY source, text")
def k11_added(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents added unless their content is in the dossier already."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("dossier"), F.sha2("text", 256).alias("sha"))
    gone = table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id")
    return merge.deleted(d, gone, ["doc_id"]).groupBy("dossier", "sha").agg(F.min("doc_id").alias("doc_id"))


@query("SELECT 0::BIGINT AS documents, count(*)::BIGINT AS defaults FROM (VALUES ('schema'), ('chunker')) t(k)")
def k12_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state after a reset: no documents, the default entries."""
    empty = table(spark, sf_dir, "documents").where("false").agg(F.count(F.lit(1)).alias("documents"))
    return empty.crossJoin(spark.createDataFrame([("schema",), ("chunker",)], "k string").agg(F.count(F.lit(1)).alias("defaults")))


@query("SELECT conv_id, turn, CASE WHEN contains(text, 'the') THEN 'word' WHEN length(text) > 100 THEN 'line' WHEN role = 'user' THEN 'block' ELSE 'page' END AS level FROM conversations")
def m04_projection_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first level that resolves a label."""
    level = F.coalesce(F.when(F.contains("text", F.lit("the")), F.lit("word")), F.when(F.length("text") > 100, F.lit("line")), F.when(F.col("role") == "user", F.lit("block")), F.lit("page"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", level.alias("level"))
