"""Annotations over planted pages and the driver's rows: pages to read, kept fields, scores and repairs of instances."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import repair
from ..functions import values
from ..operators import annotation as A
from ..operators import boxes as B
from ..operators import candidates as C
from .bindings import lines, sql_fold, table, with_archive
from .canonical import gathered, line_parts, line_words, word_box
from .pagequeries import PAGES, planted
from .registry import query


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planted pages of eight lines, so that documents have many: (doc_id, page, first_line, text)."""
    rows = planted(spark, sf_dir).withColumn("page", F.floor(F.col("ord") / 8).cast("int")).where("page < 12")
    own = rows.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("ord", "text"))).alias("x"))
    dense = F.row_number().over(Window.partitionBy("doc_id").orderBy("page")) - 1
    return own.select("doc_id", dense.alias("page"), F.get("x", F.lit(0)).text.alias("first_line"), F.array_join(F.transform("x", lambda k: k.text), "\n").alias("text"))


def _squeezed(x: str) -> str:
    return f"trim(regexp_replace({sql_fold(x)}, '\\s+', ' ', 'g'))"


_POINTS = " + ".join(f"CASE WHEN contains(n, '{w}') THEN {p} ELSE 0 END" for p, words in A.PAGE_KEYWORDS for w in words)
_PAGES = f"""{PAGES}, leaves AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY leaf) - 1)::INT AS page, first_line, text FROM (SELECT doc_id, (ord // 8)::INT AS leaf, arg_min(text, ord) AS first_line, string_agg(text, chr(10) ORDER BY ord) AS text FROM planted WHERE ord // 8 < 12 GROUP BY ALL)),
marked AS (SELECT doc_id, page, text, count(*) OVER (PARTITION BY doc_id) AS pages, contains({_squeezed('first_line')}, 'phu luc') AS appendix, {_squeezed('text')} AS n FROM leaves),
pointed AS (SELECT *, {_POINTS} AS points FROM marked),
scored_pages AS (SELECT doc_id, page, text, pages, appendix, (points + CASE WHEN points > 0 AND pages > 2 AND page >= pages - 2 THEN 1 ELSE 0 END - CASE WHEN appendix THEN 4 ELSE 0 END)::INT AS score FROM pointed),
chosen AS (SELECT doc_id, min(page) AS p, max(pages) AS n, coalesce(max(page) FILTER (NOT appendix), max(page)) AS z, max((score, page)) FILTER (score > 0 AND NOT appendix AND page > 0) AS b, list(page ORDER BY page) AS every FROM scored_pages GROUP BY doc_id),
selection AS (SELECT doc_id, p AS "primary", CASE WHEN n <= 3 THEN every WHEN b IS NOT NULL THEN list_sort(list_distinct([p, z, b[2]])) ELSE list_sort(list_distinct([p, z])) END AS selected,
  CASE WHEN n = 1 THEN NULL WHEN n > 3 AND b IS NOT NULL THEN b[2] WHEN z <> p THEN z END AS signature,
  CASE WHEN n = 1 THEN 'single_page_document' WHEN n <= 3 THEN 'all_pages_small_document' WHEN b IS NOT NULL THEN 'first_last_plus_keyword_match' ELSE 'first_last_non_appendix' END AS strategy,
  CASE WHEN n <= 3 OR coalesce(b[1] >= 5, false) THEN 'high' ELSE 'medium' END AS confidence, n > 3 AND coalesce(b[1] < 5, false) AS needs_review FROM chosen)"""


@query(f"{_PAGES} SELECT doc_id, page, score, appendix FROM scored_pages")
def e05_page_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of each page by words of signatures, recipients and roles."""
    return A.page_candidates(pages(spark, sf_dir)).select("doc_id", "page", "score", "appendix")


@query(f"{_PAGES} SELECT doc_id, array_to_string(selected, ',') AS selected, \"primary\", signature, strategy, confidence, needs_review FROM selection")
def e06_page_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages of each document worth reading, and why."""
    return A.page_selection(pages(spark, sf_dir)).withColumn("selected", F.array_join(F.transform("selected", lambda x: x.cast("string")), ","))


@query(f"""{_PAGES}, tried AS (SELECT s.*, {_squeezed('p.text')} AS t FROM selection s LEFT JOIN scored_pages p ON p.doc_id = s.doc_id AND p.page = s.signature),
hits AS (SELECT *, CASE WHEN NOT needs_review OR confidence = 'high' THEN NULL WHEN contains(t, 'nguyen van an') THEN 'exact' WHEN contains(t, 'van an') THEN 'partial' END AS match FROM tried)
SELECT doc_id, CASE WHEN match IS NOT NULL THEN 'high' ELSE confidence END AS confidence, needs_review AND match IS NULL AS needs_review, match FROM hits""")
def e07_boosted_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selections that the signer's name on the signature page makes sure."""
    own = pages(spark, sf_dir)
    signers = own.select("doc_id").distinct().withColumn("signer", F.lit("Nguyễn Văn  AN"))
    return A.boosted_selection(A.page_selection(own), signers, own).select("doc_id", "confidence", "needs_review", "match")


_LABELS = ("DOC_SUBJECT", "RECIPIENTS", "SIGNER_NAME", "PLACE_DATE", "DOC_NUMBER_SYMBOL", "SIGNER_ROLE", "ADDRESSEE")


def _instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each planted line as an instance of a label."""
    label = F.element_at(F.array(*map(F.lit, _LABELS)), (F.col("ord") % len(_LABELS) + 1).cast("int"))
    return planted(spark, sf_dir).select("doc_id", "ord", (F.floor(F.col("ord") / 8) + F.col("doc_id") % 2).cast("int").alias("page"), label.alias("label"), "text")


_INSTANCES = f"{PAGES}, instances AS (SELECT doc_id, ord, (ord // 8 + doc_id % 2)::INT AS page, {list(_LABELS)}[(ord % {len(_LABELS)}) + 1] AS label, text FROM planted)"


@query(f"{_INSTANCES} SELECT doc_id, ord, label FROM (SELECT *, bool_or(page = 0) OVER (PARTITION BY doc_id) AS has_first FROM instances) WHERE NOT has_first OR page = 0 OR label IN {A.OTHER_PAGES}")
def e10_primary_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of the first page, and recipients and signers of others."""
    return A.primary_page_fields(_instances(spark, sf_dir)).select("doc_id", "ord", "label")


def _score_sql() -> str:
    when = lambda c, x: f"CASE WHEN {c} THEN {x}::DOUBLE ELSE 0 END"
    anchored = " OR ".join(f"(label = '{k}' AND (" + " OR ".join(f"contains(n, '{w}')" for w in words) + "))" for k, words in A.ANCHORS.items())
    date = "\\b(ngay\\s*[0-9]{1,2}\\s*thang\\s*[0-9]{1,2}|tp\\.?\\s*ho\\s+chi\\s+minh|ha\\s+noi)"
    parts = [
        "least(2.5::DOUBLE, own * 0.08::DOUBLE)", "0.15::DOUBLE", "least(2.0::DOUBLE, greatest(-2.0::DOUBLE, (ord % 9 - 4)::DOUBLE))", when(anchored, 1.2), f"CASE WHEN label IN {A.FIRST_PAGE} THEN greatest(0, 1 - page * 0.35::DOUBLE) ELSE 0 END",
        "CASE WHEN label = 'RECIPIENTS' THEN least(1.2::DOUBLE, page * 0.15::DOUBLE) ELSE 0 END", "-" + when("label = 'DOC_SUBJECT' AND length(n) < 10", 2.5), "-" + when("label = 'DOC_SUBJECT' AND (num OR dat)", 1.5), "-" + when("label = 'DOC_NUMBER_SYMBOL' AND NOT num", 1.0),
        "-" + when("label = 'PLACE_DATE' AND NOT dat", 1.0), "-" + when("label = 'RECIPIENTS' AND NOT contains(n, 'noi nhan')", 0.7), "-" + when("page >= 2", 2.0), "-" + when("ord % 11 = 0", 1.0),
    ]
    return f"{_INSTANCES}, prepared AS (SELECT *, CASE WHEN n = '' THEN 0 ELSE len(string_split(n, ' ')) END AS own, regexp_matches(n, '\\bso\\s*[:.]?\\s*[0-9]') AS num, regexp_matches(n, '{date}') AS dat FROM (SELECT *, {_squeezed('text')} AS n FROM instances)) SELECT doc_id, ord, round({' + '.join(parts)}, 6) AS score FROM prepared"


@query(_score_sql())
def e13_instance_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well each instance fits its label."""
    box = F.array(F.lit(0.0), F.lit(0.0), F.when(F.col("ord") % 11 == 0, 0.0).otherwise(10.0), F.lit(5.0))
    score = A.instance_score(F.col("label"), F.col("text"), F.lit(None).cast("int"), F.lit(1), (F.col("ord") % 9 - 4).cast("double"), F.col("page"), F.lit(2), box)
    return _instances(spark, sf_dir).select("doc_id", "ord", F.round(score, 6).alias("score"))


@query(with_archive("""SELECT doc_id, pos, CASE WHEN f1 >= 0.88::DOUBLE AND r >= 0.85::DOUBLE THEN 1 WHEN f1 > 0.2::DOUBLE THEN NULL ELSE 0 END AS target, round(f1, 6) AS f1 FROM (SELECT doc_id, pos, r, 2 * p * r / greatest(p + r, 1e-9::DOUBLE) AS f1 FROM (SELECT doc_id, pos, least(n, 6) / n::DOUBLE AS r, least(n, 6) / 6.0::DOUBLE AS p FROM (SELECT doc_id, pos, least(40, len(list_filter(string_split(line, ' '), lambda w: w <> ''))) AS n FROM lines)))"""))
def g09_candidate_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of six words against a gold value that is the whole line."""
    ids = F.transform("words", lambda w: w.id)
    own = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: F.concat(F.lit("w"), i))
    gold = F.array(F.struct(F.lit("g").alias("field_id"), ids.alias("word_ids")), F.struct(F.lit("h").alias("field_id"), F.array(F.lit("z")).alias("word_ids")))
    m = A.candidate_match(F.lit("DOC_SUBJECT"), own, gold)
    return line_words(spark, sf_dir).withColumn("m", m).select("doc_id", "pos", "m.target", F.round("m.f1", 6).alias("f1"))


@query()
def g11_bridged_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags of a line's words with restarts joined and unsure gaps bridged."""
    label = lambda w, i: F.when(F.length(w.text) > 5, F.concat(F.when(i % 3 == 0, "B-").otherwise("I-"), F.when(i % 5 < 4, "DOC_SUBJECT").otherwise("RECIPIENTS"))).otherwise(F.lit("O"))
    rows = line_words(spark, sf_dir).select("doc_id", "pos", F.transform("words", label).alias("tags"), F.transform("words", lambda w: w.box).alias("boxes"), F.transform("words", lambda w: F.length(w.text) % 10 / 10.0).alias("scores"))
    return A.repaired_rows(rows, "tags", "boxes", "scores").select("doc_id", "pos", "joined", "bridged", F.array_join("repaired", " ").alias("tags"))


@query()
def g15_split_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of lines cut at their marks, with boxes by characters."""
    words = line_words(spark, sf_dir).select("doc_id", "pos", F.inline("words")).select("doc_id", "pos", "ord", "text", "box", (F.col("ord") * 10).alias("start"))
    return A.split_tokens(words, "text", "box", "start").where(F.size("parts") > 1).select("doc_id", "pos", "ord", F.posexplode("parts").alias("part", "p")).select("doc_id", "pos", "ord", "part", "p.text", "p.start")


@query()
def g25_auxiliary_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions of a page with footnotes and headers of another analysis."""
    region = lambda i, kind, y: F.struct(F.lit(i).alias("id"), F.lit(kind).alias("type"), F.array(F.lit(0.0), y, F.lit(100.0), y + 10).alias("bbox"), F.lit(None).cast("string").alias("source"))
    y = (F.col("doc_id") % 3).cast("double") * 0.02
    rows = table(spark, sf_dir, "documents").select("doc_id", F.array(region("a", "Footnote", F.lit(0.0)), region("b", "table", y)).alias("p"), F.array(region("c", "Footnote", y), region("d", "Table", y), region(None, "Page-footer", y)).alias("q"))
    return A.with_auxiliary(rows, "p", "q").select("doc_id", F.inline("regions")).select("doc_id", "id", "type", "source")


@query("SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN lpad((1 + doc_id % 28)::VARCHAR, 2, '0') || '/' || lpad((1 + doc_id % 12)::VARCHAR, 2, '0') || '/2024' WHEN 1 THEN '05/06/2023' WHEN 2 THEN '31/02/2049' WHEN 3 THEN '01/02/1950' ELSE 'không có' END AS shown FROM documents")
def h36_formatted_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issue dates as shown: of a fixed form, of a line with a place, of any numbers."""
    n = F.col("doc_id")
    raw = F.when(n % 5 == 0, F.concat_ws("-", F.lit(2024), F.lpad((1 + n % 12).cast("string"), 2, "0"), F.lpad((1 + n % 28).cast("string"), 2, "0"))).when(n % 5 == 1, "Hà Nội, ngày 5 tháng 6 năm 2023").when(n % 5 == 2, "31/2/49").when(n % 5 == 3, " ngày 1.2.50 ").otherwise("không  có")
    return table(spark, sf_dir, "documents").select("doc_id", values.issue_date(raw).alias("shown"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 2 THEN '0' ELSE '0,' || (doc_id % 3 + 1) END AS pages FROM documents")
def l08_selected_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first page and the signer's, if there is one."""
    signer = F.when(F.col("doc_id") % 3 < 2, F.col("doc_id") % 3 + 1).cast("int")
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.transform(values.pages_to_read(signer, F.lit(3)), lambda x: x.cast("string")), ",").alias("pages"))


@query("WITH x AS (SELECT l_orderkey, l_linenumber % 3 AS w, [l_quantity / 10.07::DOUBLE, l_discount * 40.123::DOUBLE, l_tax * 51.7::DOUBLE] AS z FROM lineitem), p AS (SELECT l_orderkey, w, list_transform(z, lambda v: exp(v) / (exp(z[1]) + exp(z[2]) + exp(z[3]))) AS p FROM x), m AS (SELECT l_orderkey, w, avg(p[1]) AS a, avg(p[2]) AS b, avg(p[3]) AS c FROM p GROUP BY 1, 2) SELECT l_orderkey, w::INT AS w, CASE WHEN round(a, 9) >= round(greatest(b, c), 9) THEN 'O' WHEN round(b, 9) >= round(c, 9) THEN 'B-x' ELSE 'I-x' END AS label, round(greatest(a, b, c), 6) AS score FROM m")
def m21_mean_logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of words by the mean probabilities of their pieces."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_linenumber") % 3).cast("int").alias("w"), F.array(F.col("l_quantity") / 10.07, F.col("l_discount") * 40.123, F.col("l_tax") * 51.7).alias("z"))
    words = rows.select("l_orderkey", "w").distinct()
    return A.word_labels(rows, words, ["l_orderkey", "w"], "z", ["O", "B-x", "I-x"]).select("l_orderkey", "w", "label", F.round("score", 6).alias("score"))


def _numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("pos") % 7 == 0, F.concat(F.lit("- "), (F.col("pos") % 40).cast("string"))).when(F.col("pos") % 7 == 1, F.concat((F.col("pos") % 40).cast("string"), F.lit(":"))).when(F.col("pos") % 7 == 2, F.concat((F.col("pos") * 37).cast("string"), F.lit("."))).otherwise(F.col("line"))
    return lines(spark, sf_dir).select("doc_id", "page", F.col("pos").alias("ord"), F.col("y0").alias("y"), text.alias("text"))


@query(with_archive("SELECT doc_id, ord, length(t) < 5 AND regexp_matches(t, '^[0-9!@#$%^&*():;,.\\-]+$') AND regexp_matches(t, '[0-9]') AND (length(t) < 3 OR up = 1 OR down = 1) AS is_page_number FROM (SELECT doc_id, pos AS ord, trim(CASE pos % 7 WHEN 0 THEN '- ' || (pos % 40) WHEN 1 THEN (pos % 40) || ':' WHEN 2 THEN (pos * 37) || '.' ELSE line END) AS t, row_number() OVER (PARTITION BY doc_id, page ORDER BY y0, pos) AS up, row_number() OVER (PARTITION BY doc_id, page ORDER BY y0 DESC, pos DESC) AS down FROM lines)"))
def b11_page_number_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page numbers by their form and place."""
    return A.page_numbers(_numbers(spark, sf_dir), ["doc_id", "page"]).select("doc_id", "ord", "is_page_number")


_BULLETS = ("1. ", "1.2. ", "18.000 ", "IV. ", "đ) ", "12) ", "(3) ", "(b) ", "(c)", "2024.", "x ")


@query(with_archive(f"SELECT doc_id, pos, [true, true, false, true, true, true, true, true, false, false, false][pos % {len(_BULLETS)} + 1] AS bullet FROM lines WHERE NOT regexp_matches(line, '^\\s')"))
def b14_bullets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that begin with a numbered bullet."""
    head = F.element_at(F.array(*map(F.lit, _BULLETS)), (F.col("pos") % len(_BULLETS) + 1).cast("int"))
    return lines(spark, sf_dir).where("line not rlike '^[\\\\s]'").select("doc_id", "pos", A.numbered_bullet(F.concat(F.lit("  "), head, "line")).alias("bullet"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey || '-' || o_orderstatus WHEN o_orderkey % 3 = 0 THEN o_orderstatus ELSE 'old' END AS number_symbol, CASE WHEN o_orderkey % 3 = 0 THEN 'old issuer' ELSE 'Sở  Nội vụ' END AS x, CASE WHEN o_orderkey % 3 = 0 THEN 'old superior' ELSE '' END AS superior FROM orders".replace("Sở  Nội", "Sở Nội"))
def b30_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored fields with those of the final form over them."""
    n = F.col("o_orderkey")
    form = {"number": F.when(n % 2 == 0, n.cast("string")), "symbol": F.when((n % 2 == 0) | (n % 3 == 0), F.col("o_orderstatus")), "subject": F.lit(" "), "issuer": F.when(n % 3 != 0, F.lit(" Sở  Nội vụ")), "type": F.lit(None).cast("string"), "signer": F.lit(""), "secrecy": F.lit("")}
    stored = {"number_symbol": F.lit("old"), "issuer": F.lit("old issuer"), "superior": F.lit("old superior"), "subject": F.lit("s")}
    made = A.metadata_overrides(stored, form, F.lit(""))
    return table(spark, sf_dir, "orders").select("o_orderkey", made["number_symbol"].alias("number_symbol"), made["issuer"].alias("x"), made["superior"].alias("superior"))


@query("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'Số: ' || o_orderkey || '/' || o_orderstatus WHEN 1 THEN 'Số: ' || o_orderkey WHEN 2 THEN o_orderstatus ELSE '' END AS number_symbol, o_orderpriority AS secrecy, '' AS superior FROM orders")
def b31_lossy_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of a sheet as stored fields."""
    turn, none = F.col("o_orderkey") % 4, F.lit(None).cast("string")
    form = {"number": F.when(turn < 2, F.concat(F.lit(" "), F.col("o_orderkey").cast("string"))), "symbol": F.when(turn % 2 == 0, F.col("o_orderstatus")), "confidentiality": F.col("o_orderpriority"), "issuer": none, "subject": none, "signer": none, "type": none, "access": none}
    made = A.fields_of_form(form, none)
    return table(spark, sf_dir, "orders").select("o_orderkey", *[made[c].alias(c) for c in ("number_symbol", "secrecy", "superior")])


@query("SELECT doc_id, round(sum(exact) / count(*)::DOUBLE, 6) AS exact_rate, round(sum(sim) / count(*), 6) AS text_accuracy, count(*)::BIGINT AS cells FROM (SELECT doc_id, (g = p)::INT AS exact, CASE WHEN g = '' THEN (p = '')::INT::DOUBLE ELSE greatest(0, 1 - levenshtein(g, p) / length(g)::DOUBLE) END AS sim FROM (SELECT doc_id, coalesce(g[i], '') AS g, CASE WHEN i = 3 THEN '' ELSE coalesce(g[i], '') || CASE WHEN i % 2 = 0 THEN 'x' ELSE '' END END AS p FROM (SELECT doc_id, unnest(range(1, 6)) AS i, regexp_extract_all(text, '[a-z]+')[1:4] AS g FROM documents))) GROUP BY doc_id")
def d28_cell_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of a grid against those of another with changed, missing and further ones."""
    g = F.slice(F.regexp_extract_all("text", F.lit("([a-z]+)")), 1, 4)
    changed = F.transform(F.sequence(F.lit(1), F.lit(5)), lambda i: F.when(i == 3, F.lit("")).otherwise(F.concat(F.coalesce(F.get(F.col("g"), i - 1), F.lit("")), F.when(i % 2 == 0, "x").otherwise(""))))
    rows = table(spark, sf_dir, "documents").withColumn("g", g).select("doc_id", F.array("g").alias("gold"), F.array(changed).alias("found"))
    return B.grid_similarity(rows, "doc_id", "gold", "found", repair.normalize_cell).select("doc_id", F.round("exact_rate", 6).alias("exact_rate"), F.round("text_accuracy", 6).alias("text_accuracy"), "cells")


@query()
def e23_reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of a field in reading order, with their lines, box and text."""
    # Lines are gathered as they are, and cut to words in their place: words with ids and boxes are many times the text.
    page = gathered(lines(spark, sf_dir).where("pos < 20"), "doc_id")
    word = lambda k, w, i: F.struct(F.concat(F.lit("w"), i, F.lit("_"), k.pos).alias("id"), k.pos.cast("string").alias("line_id"), w.alias("text"), word_box(k.y0, i).alias("box"))
    own = F.flatten(F.transform("x", lambda k: F.transform(line_parts(k.line), lambda w, i: word(k, w, i))))
    page = page.select("doc_id", own.alias("words"), F.array_distinct(F.transform("x", lambda k: k.pos.cast("string"))).alias("line_order"))
    made = page.withColumn("word_ids", F.reverse(F.transform(F.slice("words", 1, 30), lambda w: w.id)))
    return B.fields_in_order(made, "word_ids", "words", "line_order").select("doc_id", "field.text", F.size("field.line_ids").alias("lines"), F.col("field.box")[2].alias("x1"))


def _candidate_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages of planted lines with all their words, on 595 by 842 points; each page after a document's first may be signed."""
    pages_ = planted(spark, sf_dir).groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("ord", "text", "x0", "y0", "x1"))).alias("x"))
    parts = lambda k: F.filter(F.split(k.text, " "), lambda w: w != "")
    line_id, top = lambda k: F.concat(F.lit("l"), k.ord), lambda k: k.y0 * 842.0
    word_id = lambda k, i: F.concat(line_id(k), F.lit("_"), i)
    word = lambda k, w, i: F.struct(word_id(k, i).alias("id"), line_id(k).alias("line_id"), i.alias("order"), w.alias("text"), F.lit(True).alias("has_space_after"), F.array(k.x0 * 595.0 + i * 30.0, top(k), k.x0 * 595.0 + i * 30.0 + 28.0, top(k) + 12.0).alias("box"))
    line = lambda k: F.struct(line_id(k).alias("id"), k.ord.alias("order"), k.text.alias("text"), F.array(k.x0 * 595.0, top(k), k.x1 * 595.0, top(k) + 12.0).alias("box"), F.transform(parts(k), lambda w, i: word_id(k, i)).alias("word_ids"))
    words = F.flatten(F.transform("x", lambda k: F.transform(parts(k), lambda w, i: word(k, w, i))))
    role = F.when(F.col("page") > 0, "signature").otherwise("primary")
    return pages_.select("doc_id", "page", F.transform("x", line).alias("lines"), words.alias("words"), F.lit(595.0).alias("width"), F.lit(842.0).alias("height"), role.alias("role"))


@query()
def g06_line_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of lines where each field may stand."""
    found = C.candidates(_candidate_pages(spark, sf_dir), sources=("line_span",), columns=("field", "n_lines"))
    return found.groupBy("doc_id", "page", "field").agg(F.count(F.lit(1)).alias("n"), F.max("n_lines").alias("longest"))


@query()
def g07_word_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of words around numbers and dates, and of words like names."""
    return C.candidates(_candidate_pages(spark, sf_dir), sources=("word_window",), columns=("field", "text"))
