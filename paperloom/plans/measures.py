"""Measures, ordered operators and selections over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import measures as M
from ..operators import spans as S
from .bindings import documents, lines, table, with_archive
from .registry import query

_GOLD = "(SELECT doc_id, quality = 1 AS gold, (doc_id * 37 % 101) / 100.0::DOUBLE AS score, source FROM labels JOIN documents USING (doc_id))"
_GRID = [0.1, 0.25, 0.4, 0.5, 0.75, 0.9]


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    return both.select("doc_id", (F.col("quality") == 1).alias("gold"), (F.col("doc_id") * 37 % 101 / 100.0).alias("score"), "source")


_CONFUSION = """count(*) FILTER (WHERE gold AND p)::BIGINT AS tp, count(*) FILTER (WHERE NOT gold AND p)::BIGINT AS fp, count(*) FILTER (WHERE gold AND NOT p)::BIGINT AS fn, count(*) FILTER (WHERE NOT gold AND NOT p)::BIGINT AS tn"""
_RATIOS = """coalesce((tp + tn) / nullif(tp + fp + fn + tn, 0), 0.0)::DOUBLE AS accuracy, coalesce(tp / nullif(tp + fp, 0), 0.0)::DOUBLE AS "precision", coalesce(tp / nullif(tp + fn, 0), 0.0)::DOUBLE AS recall, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0.0)::DOUBLE AS f1"""
_SWEEP = f"SELECT *, {_RATIOS} FROM (SELECT threshold, {_CONFUSION} FROM (SELECT gold, t.threshold, score >= t.threshold AS p FROM {_GOLD}, (SELECT unnest({_GRID})::DOUBLE AS threshold) t) GROUP BY threshold)"


@query(f"SELECT *, {_RATIOS} FROM (SELECT {_CONFUSION} FROM (SELECT gold, score >= 0.5 AS p FROM {_GOLD}))")
def d08_binary_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.confusion(_scored(spark, sf_dir), F.col("gold"), F.col("score") >= 0.5)


@query(f"""SELECT round(sum(CASE WHEN g.gold AND NOT h.gold THEN CASE WHEN g.score > h.score THEN 1.0::DOUBLE WHEN g.score = h.score THEN 0.5 ELSE 0 END END) / sum(CASE WHEN g.gold AND NOT h.gold THEN 1.0::DOUBLE END), 9) AS auc FROM {_GOLD} g, {_GOLD} h""")
def d08_roc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.area_under_curve(_scored(spark, sf_dir), "gold", "score").select(F.round("auc", 9).alias("auc"))


@query(_SWEEP)
def d10_threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.threshold_sweep(_scored(spark, sf_dir), "gold", "score", _GRID)


@query(f"SELECT threshold, f1, recall FROM ({_SWEEP}) WHERE recall >= 0.3 ORDER BY f1 DESC, \"precision\" DESC, recall DESC, abs(threshold - 0.5), threshold LIMIT 1")
def d11_tuned_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.best_threshold(M.threshold_sweep(_scored(spark, sf_dir), "gold", "score", _GRID), 0.3)


@query(f"""SELECT avg(hit)::DOUBLE AS top2_hit, avg(first)::DOUBLE AS top1_exact FROM (SELECT source, max(CASE WHEN r <= 2 AND gold THEN 1.0::DOUBLE ELSE 0 END) AS hit, max(CASE WHEN r = 1 AND gold THEN 1.0::DOUBLE ELSE 0 END) AS first
FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id) AS r FROM {_GOLD}) GROUP BY source)""")
def d09_topk_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-group hit rates of the best two and of the best."""
    best = M.top_k(_scored(spark, sf_dir), ["source"], [F.col("score").desc(), F.col("doc_id")], 2)
    flag = lambda c: F.max(F.when(c, 1.0).otherwise(0.0))
    return best.groupBy("source").agg(flag(F.col("gold")).alias("hit"), flag(F.col("gold") & (F.col("rank") == 1)).alias("first")).agg(F.avg("hit").alias("top2_hit"), F.avg("first").alias("top1_exact"))


@query("SELECT lang AS split, sum(1 - quality)::BIGINT AS negative, sum(quality)::BIGINT AS positive, count(*)::BIGINT AS total FROM labels JOIN documents USING (doc_id) GROUP BY lang")
def d12_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    return both.groupBy(F.col("lang").alias("split")).agg(F.sum(1 - F.col("quality")).alias("negative"), F.sum("quality").alias("positive"), F.count(F.lit(1)).alias("total"))


@query("SELECT event_type, round(quantile_cont(value, 0.25), 9) AS p25, round(quantile_cont(value, 0.9), 9) AS p90, round(median(value), 9) AS mid FROM events GROUP BY event_type")
def d23_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda p: F.round(F.percentile("value", F.lit(p)), 9)
    return table(spark, sf_dir, "events").groupBy("event_type").agg(at(0.25).alias("p25"), at(0.9).alias("p90"), F.round(F.median("value"), 9).alias("mid"))


@query(with_archive("SELECT doc_id, s[len(s) // 2 + 1] AS height FROM (SELECT doc_id, list_sort(list(length(line)::BIGINT)) AS s FROM lines GROUP BY doc_id)"))
def d26_upper_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The upper median of each document's line lengths."""
    sizes = lines(spark, sf_dir).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.length("line").cast("long"))).alias("s"))
    return sizes.select("doc_id", F.element_at("s", F.floor(F.size("s") / 2).cast("int") + 1).alias("height"))


@query(with_archive("SELECT doc_id, least(n, m) / greatest(n, m)::DOUBLE AS shape FROM (SELECT doc_id, count(*) AS n, max(pos) + 1 AS m FROM lines GROUP BY doc_id)"))
def d30_shape_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, m = F.col("n"), F.col("m")
    return lines(spark, sf_dir).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), (F.max("pos") + 1).alias("m")).select("doc_id", (F.least(n, m) / F.greatest(n, m)).alias("shape"))


@query(with_archive("SELECT status, fonds, count(*)::BIGINT AS n, avg(n_chars)::DOUBLE AS mean FROM docs GROUP BY status, fonds"))
def d35_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).groupBy("status", "fonds").agg(F.count(F.lit(1)).alias("n"), F.avg("n_chars").alias("mean"))


@query(with_archive("SELECT status, fonds, count(*)::BIGINT AS n FROM docs GROUP BY ROLLUP (status, fonds)"))
def d38_error_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).rollup("status", "fonds").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT label, count(*)::BIGINT AS n FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS label FROM benchmark) GROUP BY label")
def d22_label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("([A-Za-z]+)"), F.lit(1))).alias("label"))
    return words.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


_NEAREST = """SELECT q, min(r) AS rank FROM (SELECT q.vec_id AS q, q.label = d.label AS same, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_sum(list_transform(list_zip(q.embedding, d.embedding), lambda x: x[1]::DOUBLE * x[2]::DOUBLE)), 6) DESC, d.vec_id) AS r
FROM embeddings q JOIN embeddings d ON q.vec_id % 50 = 0 AND d.vec_id <> q.vec_id) WHERE same GROUP BY q"""


@query(f"SELECT avg((coalesce(rank, 99) <= 1)::INT)::DOUBLE AS recall_at_1, avg((coalesce(rank, 99) <= 3)::INT)::DOUBLE AS recall_at_3, avg((coalesce(rank, 99) <= 5)::INT)::DOUBLE AS recall_at_5, avg((coalesce(rank, 99) <= 10)::INT)::DOUBLE AS recall_at_10, round(avg(CASE WHEN rank <= 20 THEN 1.0::DOUBLE / rank ELSE 0 END), 9) AS mrr FROM ({_NEAREST})")
def d27_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries are the vectors whose id is divisible by 50, against all vectors, in blocks."""
    e = table(spark, sf_dir, "embeddings")
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("q"), F.col("embedding").alias("qe"), F.col("label").alias("ql"))
    first = M.first_relevant(e, q)
    return M.retrieval(first).withColumn("mrr", F.round("mrr", 9))


@query(with_archive("""SELECT doc_id, start, coalesce(lead(start) OVER w, total) - 1 AS "end", row_number() OVER w AS segment FROM (SELECT doc_id, pos::BIGINT AS start, (max(pos) OVER (PARTITION BY doc_id) + 1)::BIGINT AS total, pos % 7 = 0 AS cut FROM lines) WHERE cut WINDOW w AS (PARTITION BY doc_id ORDER BY start)"""))
def e01_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = lines(spark, sf_dir).select("doc_id", F.col("pos").cast("long").alias("pos"), (F.max("pos").over(Window.partitionBy("doc_id")) + 1).cast("long").alias("total"))
    return S.segments(own.where("pos % 7 = 0"), "doc_id", "pos", "total").withColumn("segment", F.col("segment").cast("long"))


@query("SELECT doc_id, array_to_string(list_sort(list_concat(list_filter([0, 3, 5], lambda x: x <> doc_id % 8), CASE WHEN list_contains([0, 3, 5], doc_id % 8) THEN [] ELSE [(doc_id % 8)::INT] END)), ',') AS cuts FROM documents")
def e02_toggle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cut that is there goes, one that isn't comes."""
    cuts, one = F.array(F.lit(0), F.lit(3), F.lit(5)), F.array((F.col("doc_id") % 8).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.array_sort(F.array_union(F.array_except(cuts, one), F.array_except(one, cuts))), ",").alias("cuts"))


@query("SELECT event_id, sum(CASE WHEN value > 30 OR first THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS segment FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1 AS first FROM events)")
def e03_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows over a threshold, and each first row, begin a segment."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    begun = table(spark, sf_dir, "events").withColumn("start", (F.col("value") > 30) | (F.row_number().over(w) == 1))
    return begun.select("event_id", F.sum(F.col("start").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("segment"))


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS r FROM events) WHERE r = 1")
def e04_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.top_k(table(spark, sf_dir, "events"), ["user_id"], [F.col("value").desc(), F.col("event_id")], 1).select("user_id", "event_id")


@query(with_archive("SELECT doc_id, pos, CASE WHEN n > 1 THEN (r - 1) / (n - 1)::DOUBLE ELSE 0 END AS position FROM (SELECT doc_id, pos, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS r, count(*) OVER (PARTITION BY doc_id) AS n FROM lines)"))
def e08_relative_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, n = F.row_number().over(Window.partitionBy("doc_id").orderBy("pos")), F.count(F.lit(1)).over(Window.partitionBy("doc_id"))
    return lines(spark, sf_dir).select("doc_id", "pos", F.when(n > 1, (r - 1) / (n - 1)).otherwise(F.lit(0.0)).alias("position"))


@query("SELECT event_id FROM (SELECT *, max((event_type = 'click')::INT) OVER (PARTITION BY user_id) AS paired FROM events) WHERE event_type <> 'view' OR paired = 1")
def e11_unpaired_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of one kind stay only where their group has the other."""
    paired = F.max((F.col("event_type") == "click").cast("int")).over(Window.partitionBy("user_id"))
    return table(spark, sf_dir, "events").withColumn("paired", paired).where("event_type <> 'view' or paired = 1").select("event_id")


@query("SELECT user_id, max(value) AS score, min(event_id) AS first FROM events GROUP BY user_id")
def e19_dedupe_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("value").alias("score"), F.min("event_id").alias("first"))


_TAGS = "(SELECT conv_id AS doc, turn AS i, role AS word, (length(text) % 100) / 100.0::DOUBLE AS score, (['O', 'B-A', 'I-A', 'I-B'])[length(text) % 4 + 1] AS tag FROM conversations)"


def _tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length("text")
    tag = F.element_at(F.array(*map(F.lit, ("O", "B-A", "I-A", "I-B"))), n % 4 + 1)
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("i"), F.col("role").alias("word"), (n % 100 / 100.0).alias("score"), tag.alias("tag"))


@query(f"""SELECT doc, field, min(i) AS first, max(i) AS last, string_agg(word, ' ' ORDER BY i) AS text, round(avg(score), 9) AS score FROM (SELECT *, sum(begins::INT) OVER (PARTITION BY doc ORDER BY i) AS island FROM (SELECT *, substr(tag, 3) AS field, tag <> 'O' AND (tag LIKE 'B-%' OR lag(substr(tag, 3), 1, '') OVER (PARTITION BY doc ORDER BY i) <> substr(tag, 3)) AS begins FROM {_TAGS})) WHERE tag <> 'O' GROUP BY doc, island, field""")
def g10_label_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.decoded_spans(_tags(spark, sf_dir), ["doc"], "i", "tag", "word", "score").withColumn("score", F.round("score", 9))


@query(f"SELECT doc, i, CASE WHEN tag LIKE 'I-%' AND before <> substr(tag, 3) THEN 'B-' || substr(tag, 3) ELSE tag END AS repaired FROM (SELECT *, lag(substr(tag, 3), 1, '') OVER (PARTITION BY doc ORDER BY i) AS before FROM {_TAGS})")
def g13_repaired_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.repaired(_tags(spark, sf_dir), ["doc"], "i").select("doc", "i", "repaired")



@query(with_archive("SELECT doc_id, page, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, string_agg(line, ' ' ORDER BY pos) AS text FROM lines GROUP BY doc_id, page"))
def g17_page_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The union box and the text of each page, in reading order."""
    text = F.array_join(F.array_sort(F.collect_list(F.struct("pos", "line"))).getField("line"), " ")
    return lines(spark, sf_dir).groupBy("doc_id", "page").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), text.alias("text"))



@query("SELECT l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_extendedprice DESC, l_linenumber) AS r FROM lineitem) WHERE r <= CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END")
def f04_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best rows of each group, as many as its kind allows."""
    r = F.row_number().over(Window.partitionBy("l_orderkey", "l_returnflag").orderBy(F.col("l_extendedprice").desc(), "l_linenumber"))
    most = F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "N", 2).otherwise(3)
    return table(spark, sf_dir, "lineitem").withColumn("r", r).where(F.col("r") <= most).select("l_orderkey", "l_linenumber")


@query("SELECT l_orderkey, arg_max(l_linenumber, (l_quantity, l_extendedprice, -l_linenumber)) AS best FROM lineitem GROUP BY l_orderkey")
def f07_best_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lexicographic maximum of several attributes."""
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max_by("l_linenumber", F.struct("l_quantity", "l_extendedprice", (-F.col("l_linenumber")).alias("n"))).alias("best"))



@query("SELECT user_id, count(*)::BIGINT AS n, count(*) FILTER (WHERE value > 20) = 3 AS complete FROM events GROUP BY user_id")
def l02_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files whose pages have all come in."""
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), (F.count_if(F.col("value") > 20) == 3).alias("complete"))
