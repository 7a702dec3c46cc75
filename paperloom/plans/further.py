"""Further archive, dataset, geometry and text queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..operators import measures as M
from .bindings import documents, lines, sql_fold, sql_tokens, table, with_archive
from .registry import query


@query("WITH old AS (SELECT event_type AS k, count(*)::BIGINT AS v FROM events WHERE event_type <> 'view' GROUP BY 1), new AS (SELECT * FROM (VALUES ('click', 1::BIGINT), ('brand-new', 2::BIGINT)) t(k, v)) SELECT * FROM old UNION ALL SELECT * FROM new WHERE k NOT IN (SELECT k FROM old)")
def a03_seeded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Defaults are added only for keys that are missing."""
    old = table(spark, sf_dir, "events").where("event_type <> 'view'").groupBy(F.col("event_type").alias("k")).agg(F.count(F.lit(1)).alias("v"))
    new = spark.createDataFrame([("click", 1), ("brand-new", 2)], "k string, v long")
    return old.unionByName(new.join(old.select("k"), "k", "left_anti"))


@query("SELECT count(*)::BIGINT AS value FROM events WHERE event_type = 'click'")
def a04_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").where("event_type = 'click'").agg(F.count(F.lit(1)).alias("value"))


@query("SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events")
def a30_json_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field of a JSON column by an explicit schema."""
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k long").getField("k").alias("k"))


@query(with_archive("SELECT doc_id, pos, line AS text FROM lines"))
def a11_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks out of nested documents: packed to JSON, parsed by a schema, taken apart."""
    packed = lines(spark, sf_dir).groupBy("doc_id").agg(F.to_json(F.struct(F.collect_list(F.struct("pos", F.col("line").alias("text"))).alias("blocks"))).alias("canonical"))
    parsed = packed.select("doc_id", F.from_json("canonical", "blocks array<struct<pos: int, text: string>>").alias("c"))
    return parsed.select("doc_id", F.inline("c.blocks"))


@query(with_archive("SELECT doc_id, pos, x0, y0, x0 + (x1 - x0) AS x1, y0 + (y1 - y0) AS y1 FROM lines"))
def a13_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A box given as corners, or else as a corner and sizes."""
    own = lines(spark, sf_dir).withColumn("bbox", F.when(F.col("pos") % 2 == 0, F.array("x0", "y0", "x1", "y1"))).withColumn("w", F.col("x1") - F.col("x0")).withColumn("h", F.col("y1") - F.col("y0"))
    box = F.when(F.size("bbox") >= 4, F.slice("bbox", 1, 4)).otherwise(F.array("x0", "y0", F.col("x0") + F.col("w"), F.col("y0") + F.col("h")))
    return own.select("doc_id", "pos", *[F.element_at(box, i + 1).alias(s) for i, s in enumerate(("x0", "y0", "x1", "y1"))])


@query("SELECT q.item_id, d.doc_id FROM (SELECT item_id, item_id * 3 AS doc_id, item_id % 3 AS score FROM benchmark) q JOIN documents d USING (doc_id) WHERE q.score > 0")
def a26_relevant_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positive pairs whose document exists."""
    q = table(spark, sf_dir, "benchmark").select("item_id", (F.col("item_id") * 3).alias("doc_id"), (F.col("item_id") % 3).alias("score"))
    return q.where("score > 0").join(table(spark, sf_dir, "documents").select("doc_id"), "doc_id").select("item_id", "doc_id")


@query(with_archive(f"""SELECT doc_id, list_has_all(list_transform(list_filter({sql_tokens('subject')}, lambda t: length(t) >= 2 OR regexp_matches(t, '[0-9]')), lambda t: t), ['the', 'of'] ) AS found FROM docs"""))
def b03_number_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All tokens of a filter are in a field."""
    return documents(spark, sf_dir).select("doc_id", T.document_number_match(F.lit("the of"), F.col("subject")).alias("found"))


@query(with_archive(f"SELECT doc_id, {sql_fold('subject')} LIKE '%the%' AND status IN ('indexed', 'failed') AND n_chars >= 100 AND n_chars <= 5000 AS hit FROM docs"))
def b06_where(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filters of all kinds, joined by and."""
    hit = T.fold("subject").like("%the%") & F.col("status").isin("indexed", "failed") & (F.col("n_chars") >= 100) & (F.col("n_chars") <= 5000)
    return documents(spark, sf_dir).select("doc_id", hit.alias("hit"))


@query(with_archive("SELECT doc_id, pos FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY pos) AS a, row_number() OVER (PARTITION BY doc_id, page ORDER BY pos DESC) AS z FROM lines) WHERE NOT (length(line) < 3 OR (length(line) < 12 AND (a = 1 OR z = 1)))"))
def b12_page_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines without the shortest, and without short first and last lines of a page."""
    w = Window.partitionBy("doc_id", "page")
    own = lines(spark, sf_dir).withColumn("a", F.row_number().over(w.orderBy("pos"))).withColumn("z", F.row_number().over(w.orderBy(F.col("pos").desc())))
    return own.where(~((F.length("line") < 3) | ((F.length("line") < 12) & ((F.col("a") == 1) | (F.col("z") == 1))))).select("doc_id", "pos")



@query(with_archive(f"SELECT doc_id, pos FROM lines WHERE {sql_tokens('line')} = {sql_tokens(chr(39) + 'Anble  ANES.' + chr(39))}"))
def b16_stamp_keyword(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines whose tokens are those of a keyword, and no others."""
    return lines(spark, sf_dir).where(T.tokens("line") == T.tokens(F.lit("Anble  ANES."))).select("doc_id", "pos")


@query(with_archive(f"SELECT doc_id, mark FROM (SELECT doc_id, mark, row_number() OVER (PARTITION BY doc_id ORDER BY pos, length(mark) DESC, mark) AS r FROM lines, (SELECT unnest(['the', 'the of', 'and']) AS mark) m WHERE page = 0 AND x1 <= 300 AND contains(' ' || array_to_string({sql_tokens('line')}, ' ') || ' ', ' ' || mark || ' ')) WHERE r = 1"))
def b17_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first line of the page's corner with a mark; of several marks the longest."""
    marks = F.array(*map(F.lit, ("the", "the of", "and")))
    words = F.concat(F.lit(" "), F.array_join(T.tokens("line"), " "), F.lit(" "))
    found = F.filter(marks, lambda m: F.contains(words, F.concat(F.lit(" "), m, F.lit(" "))))
    hits = lines(spark, sf_dir).where("page = 0 and x1 <= 300").select("doc_id", "pos", F.explode(found).alias("mark"))
    return M.top_k(hits, ["doc_id"], [F.col("pos"), F.length("mark").desc(), F.col("mark")], 1).select("doc_id", "mark")



@query("SELECT conv_id, max(CASE WHEN role = 'user' THEN text END) AS user_text, max(CASE WHEN role = 'assistant' THEN text END) AS assistant_text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS r FROM conversations) WHERE r = 1 GROUP BY conv_id")
def b32_export_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels to columns: the first instance of each."""
    first = M.top_k(table(spark, sf_dir, "conversations"), ["conv_id", "role"], [F.col("turn")], 1)
    pick = lambda r: F.max(F.when(F.col("role") == r, F.col("text"))).alias(f"{r}_text")
    return first.groupBy("conv_id").agg(pick("user"), pick("assistant"))


_WORDS = "(SELECT doc_id, page, pos, x0 AS wx0, y0 AS wy0, x1 AS wx1, y1 AS wy1 FROM lines)"



@query("SELECT a.doc_id, min(b.doc_id) AS twin FROM documents a JOIN documents b ON a.text = b.text AND a.doc_id <> b.doc_id GROUP BY a.doc_id")
def c10_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first other document with the same content, by digests: two small values for each content, no pairs."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha"))
    firsts = d.withColumn("r", F.row_number().over(Window.partitionBy("sha").orderBy("doc_id"))).where("r <= 2").groupBy("sha").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"))
    return d.join(firsts.where("a <> b"), "sha").select("doc_id", F.when(F.col("doc_id") == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("twin"))



@query("SELECT event_type, count(*) FILTER (WHERE value < 20)::BIGINT AS early, count(*) FILTER (WHERE value >= 20)::BIGINT AS late FROM events GROUP BY event_type")
def d14_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count_if(F.col("value") < 20).alias("early"), F.count_if(F.col("value") >= 20).alias("late"))


@query("""SELECT coalesce(sum(tp) / nullif(sum(tp) + sum(fp), 0), 0.0)::DOUBLE AS p, coalesce(sum(tp) / nullif(sum(tp) + sum(fn), 0), 0.0)::DOUBLE AS r FROM (SELECT l_orderkey, count(*) FILTER (WHERE l_returnflag = 'A' AND l_linestatus = 'F') AS tp, count(*) FILTER (WHERE l_returnflag = 'A' AND l_linestatus <> 'F') AS fp, count(*) FILTER (WHERE l_returnflag <> 'A' AND l_linestatus = 'F') AS fn FROM lineitem GROUP BY l_orderkey)""")
def d15_micro_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision and recall of counts summed over documents."""
    gold, hit = F.col("l_linestatus") == "F", F.col("l_returnflag") == "A"
    return M.confusion(table(spark, sf_dir, "lineitem"), gold, hit).select(F.col("precision").alias("p"), F.col("recall").alias("r"))


@query("SELECT l_orderkey, arg_max(l_linenumber, (l_quantity, -l_extendedprice, -l_linenumber)) AS best, max(l_quantity) AS f1 FROM lineitem GROUP BY l_orderkey")
def d16_oracle_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best candidate of each gold value: what a perfect choice could reach."""
    rank = F.struct("l_quantity", (-F.col("l_extendedprice")).alias("p"), (-F.col("l_linenumber")).alias("n"))
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max_by("l_linenumber", rank).alias("best"), F.max("l_quantity").alias("f1"))


_GRIDS = "(SELECT doc_id, pos AS r, unnest(range(len(string_split(line, ' | '))))::INT AS c, unnest(string_split(line, ' | ')) AS cell FROM lines WHERE contains(line, ' | '))"



@query("SELECT source, count(*)::BIGINT AS n, count(DISTINCT lang)::BIGINT AS labels, min(n_chars) AS least, max(n_chars) AS most, round(avg(n_chars), 6)::DOUBLE AS mean FROM documents GROUP BY source")
def d37_dataset_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").groupBy("source")
    return d.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("lang").alias("labels"), F.min("n_chars").alias("least"), F.max("n_chars").alias("most"), F.round(F.avg("n_chars"), 6).alias("mean"))


@query("SELECT lang, count(*) FILTER (WHERE n_chars < 1000)::BIGINT AS short, count(*) FILTER (WHERE n_chars BETWEEN 1000 AND 5000)::BIGINT AS middle, count(*) FILTER (WHERE n_chars > 5000)::BIGINT AS long FROM documents GROUP BY lang")
def d36_status_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("n_chars") < 1000, "short").when(F.col("n_chars") <= 5000, "middle").otherwise("long")
    return table(spark, sf_dir, "documents").withColumn("kind", kind).groupBy("lang").pivot("kind", ["short", "middle", "long"]).agg(F.count(F.lit(1))).na.fill(0)



@query("SELECT l_orderkey, l_returnflag, any_value(pages) AS pages, arg_max(l_linestatus, (total, l_linestatus)) AS best FROM (SELECT l_orderkey, l_returnflag, l_linestatus, sum(l_quantity) AS total, count(*) OVER (PARTITION BY l_orderkey, l_returnflag)::BIGINT AS pages FROM lineitem GROUP BY 1, 2, 3) GROUP BY 1, 2")
def e14_cardinality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merged for each page, then the best page of each field."""
    pages = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("total"))
    return pages.groupBy("l_orderkey", "l_returnflag").agg(F.count(F.lit(1)).alias("pages"), F.max_by("l_linestatus", F.struct("total", "l_linestatus")).alias("best"))


@query("SELECT DISTINCT name FROM (SELECT first_value(trim(c_mktsegment)) OVER (PARTITION BY lower(trim(c_mktsegment)) ORDER BY c_custkey) AS name FROM customer UNION ALL SELECT 'Other')")
def f06_display_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One spelling of each folded name, and a fallback."""
    names = table(spark, sf_dir, "customer").select("c_custkey", F.trim("c_mktsegment").alias("name"))
    first = names.groupBy(T.fold("name").alias("k")).agg(F.min_by("name", "c_custkey").alias("name"))
    return first.select("name").unionByName(spark.range(1).select(F.lit("Other").alias("name"))).orderBy("name")


@query("SELECT vec_id, label FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY embedding[1] DESC, vec_id) AS r FROM embeddings) WHERE r <= 5")
def f03_top_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.top_k(table(spark, sf_dir, "embeddings"), ["label"], [F.element_at("embedding", 1).desc(), F.col("vec_id")], 5).select("vec_id", "label")



@query("SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '[A-Za-z]+'))), ' ') AS words FROM documents")
def g18_ordered_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.array_sort(F.array_distinct(F.regexp_extract_all("text", F.lit("([A-Za-z]+)"), F.lit(1)))), " ").alias("words"))


@query("SELECT DISTINCT text FROM benchmark UNION SELECT DISTINCT text FROM conversations WHERE turn = 0")
def g22_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of both sources, each once."""
    return table(spark, sf_dir, "benchmark").select("text").unionByName(table(spark, sf_dir, "conversations").where("turn = 0").select("text")).distinct()


@query("SELECT user_id, min(event_id) AS base, string_agg(event_type, ' ' ORDER BY ts, event_id) AS merged FROM (SELECT *, sum((event_type <> 'view')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM events) GROUP BY user_id, g")
def g23_continuation_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that continue the one before are folded into it."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    marked = table(spark, sf_dir, "events").withColumn("g", F.sum((F.col("event_type") != "view").cast("int")).over(w))
    text = F.array_join(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))).getField("event_type"), " ")
    return marked.groupBy("user_id", "g").agg(F.min("event_id").alias("base"), text.alias("merged")).drop("g")


@query(with_archive("SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS text FROM lines GROUP BY doc_id"))
def g28_rebuilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts put together again from their lines."""
    return lines(spark, sf_dir).groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("pos", "line"))).getField("line"), "\n").alias("text"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'TM. BOARD' WHEN c_custkey % 3 = 1 THEN 'KT.' ELSE '' END AS prefix FROM customer")
def h28_signer_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The authority before a signer's title."""
    turn = F.col("c_custkey") % 3
    title = F.when(turn == 0, "TM. BOARD\nCHAIR").when(turn == 1, "KT.\nDIRECTOR").otherwise("DIRECTOR")
    return table(spark, sf_dir, "customer").select("c_custkey", F.regexp_extract(title, r"^((?:TM|KT|TL|TUQ)\.[^\n]*)", 1).alias("prefix"))


@query("SELECT o_orderkey, o_orderkey::VARCHAR AS number, year(o_orderdate)::VARCHAR AS year, 'QD-UB' AS symbol FROM orders")
def h26_number_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number, year and symbol of a document number."""
    text = F.concat(F.lit("So: "), F.col("o_orderkey").cast("string"), F.lit("/"), F.year("o_orderdate").cast("string"), F.lit("/QD-UB"))
    part = lambda g: F.regexp_extract(text, r"([0-9]+)\s*/\s*(?:([0-9]{4})\s*/\s*)?([A-Za-z][\w-]*)", g)
    return table(spark, sf_dir, "orders").select("o_orderkey", part(1).alias("number"), part(2).alias("year"), part(3).alias("symbol"))


@query("SELECT o_orderkey, lpad(day(o_orderdate)::VARCHAR, 2, '0') || '/' || lpad(month(o_orderdate)::VARCHAR, 2, '0') || '/' || year(o_orderdate) AS shown, strftime(o_orderdate, '%Y-%m-%d') AS iso FROM orders")
def h34_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One date in the two written forms."""
    key = T.date_key(F.expr("concat(day(o_orderdate), '-', month(o_orderdate), '-', year(o_orderdate))"))
    part = lambda a, n: F.substring(key, a, n)
    return table(spark, sf_dir, "orders").select("o_orderkey", F.concat_ws("/", part(7, 2), part(5, 2), part(1, 4)).alias("shown"), F.concat_ws("-", part(1, 4), part(5, 2), part(7, 2)).alias("iso"))


@query("SELECT doc_id, upper(left(s, 1)) || substr(s, 2) AS sentence FROM (SELECT doc_id, lower(string_split(text, chr(10))[1]) AS s FROM documents)")
def h17_sentence_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First lines in lower case with a capital; each character by its own simple mapping, so their number stays."""
    s = table(spark, sf_dir, "documents").select("doc_id", T.simple_lower(F.element_at(F.split("text", "\n"), 1)).alias("s"))
    return s.select("doc_id", F.concat(T.simple_upper(F.substring("s", 1, 1)), F.expr("substr(s, 2)")).alias("sentence"))


@query("SELECT doc_id, text AS repaired FROM documents")
def h20_mojibake(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UTF-8 read as Latin-1 is read again; texts that are not such stay."""
    broken = F.when(F.col("doc_id") % 2 == 0, F.decode(F.encode("text", "UTF-8"), "ISO-8859-1")).otherwise(F.col("text"))
    # A lead byte with a byte that continues it: in UTF-8 read as Latin-1 one for each character beyond ASCII, in what it stood for half as many at most.
    marks = lambda c: F.regexp_count(c, F.lit("[\u00c2-\u00f4][\u0080-\u00bf]"))
    d = table(spark, sf_dir, "documents").select("doc_id", broken.alias("t"))
    fits = ~F.col("t").rlike("[^\u0000-ÿ]")
    again = F.when(fits, F.try_validate_utf8(F.expr("cast(encode(t, 'ISO-8859-1') as string)")))
    return d.withColumn("again", again).select("doc_id", F.when(F.col("again").isNotNull() & (marks("again") < marks("t")), F.col("again")).otherwise(F.col("t")).alias("repaired"))




@query("SELECT vec_id, round(list_avg(list_transform(embedding[1:32], lambda x: x::DOUBLE)), 6) AS pooled FROM embeddings")
def i18_mean_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean of the positions that a mask keeps."""
    mask = F.transform("embedding", lambda x, i: F.when(i < 32, 1.0).otherwise(0.0))
    total = F.aggregate(F.zip_with("embedding", mask, lambda x, m: x.cast("double") * m), F.lit(0.0), lambda a, x: a + x)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(total / F.aggregate(mask, F.lit(0.0), lambda a, m: a + m), 6).alias("pooled"))


@query(f"SELECT doc_id, token FROM (SELECT doc_id, unnest({sql_tokens('text')}) AS token FROM documents WHERE doc_id % 10 <> 0) WHERE length(token) >= 3 AND NOT regexp_matches(token, '^[0-9]+$') GROUP BY ALL")
def j03_postings_after_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings without those of deleted documents; tokens that fuzzy search would use."""
    gone = documents(spark, sf_dir).where("status = 'deleted'").select("doc_id")
    own = table(spark, sf_dir, "documents").select("doc_id", "text").join(gone, "doc_id", "left_anti")
    words = own.select("doc_id", F.explode(F.array_distinct(T.tokens("text"))).alias("token"))
    return words.where((F.length("token") >= 3) & ~F.col("token").rlike("^[0-9]+$"))


@query("SELECT p_partkey, stored, p_size AS current FROM (SELECT p_partkey, p_size, CASE WHEN p_partkey % 7 = 0 THEN p_size + 1 ELSE p_size END AS stored FROM part) WHERE stored <> p_size")
def k13_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored versions that differ from the current ones."""
    stored = F.when(F.col("p_partkey") % 7 == 0, F.col("p_size") + 1).otherwise(F.col("p_size"))
    return table(spark, sf_dir, "part").select("p_partkey", stored.alias("stored"), F.col("p_size").alias("current")).where("stored <> current")


@query("SELECT o_orderstatus, count(*)::BIGINT AS done, count(*) FILTER (WHERE o_totalprice < 1000)::BIGINT AS failed FROM orders GROUP BY o_orderstatus")
def k04_import_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("done"), F.count_if(F.col("o_totalprice") < 1000).alias("failed"))


@query("SELECT o_orderkey, c.c_custkey IS NOT NULL AS matched FROM orders o LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) c ON o.o_custkey = c.c_custkey")
def k02_matched_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with their metadata, and those without any."""
    meta = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), F.lit(True).alias("m"))
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(meta, "o_custkey", "left").select("o_orderkey", F.coalesce("m", F.lit(False)).alias("matched"))




@query("SELECT source, CASE WHEN share > 0.7 THEN 'digital' WHEN share > 0.3 THEN 'scan_low' ELSE 'scan_no_text' END AS kind FROM (SELECT source, avg((n_chars > 800)::INT) AS share FROM documents GROUP BY source)")
def m22_classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds by the votes of pages."""
    share = F.avg((F.col("n_chars") > 800).cast("int"))
    return table(spark, sf_dir, "documents").groupBy("source").agg(share.alias("share")).select("source", F.when(F.col("share") > 0.7, "digital").when(F.col("share") > 0.3, "scan_low").otherwise("scan_no_text").alias("kind"))


@query("SELECT doc_id FROM (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY md5(doc_id::VARCHAR), doc_id) AS r FROM labels) WHERE quality = 1 OR r <= 20")
def m06_kept_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All positives, and as many negatives as are asked for, in hash order."""
    labels = table(spark, sf_dir, "labels")
    others = labels.where("quality <> 1").orderBy("quality", F.md5(F.col("doc_id").cast("string")), "doc_id").limit(20)
    return labels.where("quality = 1").select("doc_id").unionByName(others.select("doc_id"))
