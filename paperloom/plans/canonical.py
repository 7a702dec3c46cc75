"""Boxes, tables, chunks, forms and labels over the driver's tables: each row of a document as a line, its words as boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import repair, values
from ..functions import text as T
from ..operators import boxes as B
from ..operators import chunks as C
from ..operators import kie as K
from ..operators import merge
from ..operators import tables as TB
from ..operators.batches import per_row
from ..sources import annotations, workbooks
from .bindings import lines, sql_fold, table, with_archive
from .registry import query

WORD_WIDTH, LINE_HEIGHT = 30.0, 12.0


def line_parts(line: Column) -> Column:
    """The first forty words of a line."""
    return F.slice(F.filter(F.split(line, " "), lambda w: w != ""), 1, 40)


def word_box(y: Column, i: Column, shift: Column | float = 0.0) -> Column:
    return F.array(i * WORD_WIDTH + shift, y + shift, i * WORD_WIDTH + 28.0 + shift, y + LINE_HEIGHT + shift)


def gathered(rows: DataFrame, *by: str) -> DataFrame:
    """The lines of each group as ``x``, an array of struct (pos, line, y0) by place."""
    return rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("pos", "line", "y0"))).alias("x"))


def line_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with ``words``: struct (text, id, box, ord, token), each word 28 points wide, two points apart."""
    y = F.col("y0")
    rows = lines(spark, sf_dir).withColumn("w", line_parts(F.col("line")))
    word = lambda w, i: F.struct(w.alias("text"), F.concat(F.lit("w"), i).alias("id"), word_box(y, i).alias("box"), i.cast("long").alias("ord"), T.fold(w).alias("token"))
    return rows.withColumn("words", F.transform("w", word)).drop("w")


@query("SELECT c_custkey, 'Số' || chr(10) || 'của văn bản ' || c_custkey AS h FROM customer".replace("'Số' || chr(10) || 'của văn bản ' || c_custkey", "'Số của văn bản ' || c_custkey"))
def a10_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers with hard spaces and line breaks as they are looked up."""
    raw = F.concat(F.lit(" Số\xa0của \n văn\tbản "), "c_custkey", F.lit("\xa0"))
    return table(spark, sf_dir, "customer").select("c_custkey", values.header(raw).alias("h"))


@query("SELECT c_name AS title, c_mktsegment AS fonds, NULL::VARCHAR AS catalog FROM customer WHERE NOT (c_name IS NULL AND c_mktsegment IS NULL)")
def a09_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sheet with a header row, read by header."""
    c = table(spark, sf_dir, "customer").select((F.col("c_custkey") + 1).cast("int").alias("row"), F.array("c_name", F.lit(None), "c_mktsegment").alias("values"))
    head = spark.createDataFrame([(1, [" Tiêu đề\xa0hồ sơ", "khác", "Phông\n"]), (0, ["Tiêu đề hồ sơ", None, "Phông"])], "row int, values array<string>").where("row = 0")
    return workbooks.read_sheet(c.unionByName(head), {"Tiêu đề hồ sơ": "title", "Phông": "fonds", "Mục lục": "catalog"})


@query()
def a29_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of recognition messages: a text and a box for each turn."""
    size = lambda c: F.expr(f"unhex(lpad(hex(octet_length({c})), 2, '0'))")
    c = table(spark, sf_dir, "conversations").withColumn("t", F.left("text", F.lit(30)))
    own = c.withColumn("line", F.concat(F.expr("X'1A'"), size("t"), F.col("t").cast("binary"), F.expr("X'12040805100742'"), F.expr("X'0161'")))
    message = own.withColumn("data", F.concat(F.expr("X'12'"), size("line"), F.col("line")))
    return annotations.visual_annotations(message.select("conv_id", "turn", "data"), "data").select("conv_id", "turn", F.inline("lines")).select("conv_id", "turn", "text", "box.x", "box.y")


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN lpad((1 + doc_id % 28)::VARCHAR, 2, '0') || '/' || lpad((1 + doc_id % 12)::VARCHAR, 2, '0') || '/' || (1990 + doc_id % 40) WHEN doc_id % 3 = 1 THEN lpad((1 + doc_id % 28)::VARCHAR, 2, '0') || '/' || lpad((1 + doc_id % 12)::VARCHAR, 2, '0') || '/' || CASE WHEN doc_id % 100 > 30 THEN '19' ELSE '20' END || lpad((doc_id % 100)::VARCHAR, 2, '0') ELSE 'không rõ' END AS shown FROM documents")
def h35_display_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates of forms, year first, with two-digit years, and none."""
    day, month, turn = 1 + F.col("doc_id") % 28, 1 + F.col("doc_id") % 12, F.col("doc_id") % 3
    short = F.concat(F.lit("ký ngày "), F.concat_ws(".", day, month, F.lpad((F.col("doc_id") % 100).cast("string"), 2, "0")))
    raw = F.when(turn == 0, F.concat_ws("-", 1990 + F.col("doc_id") % 40, month, day)).when(turn == 1, short).otherwise(F.lit("  không rõ "))
    return table(spark, sf_dir, "documents").select("doc_id", values.display_date(raw).alias("shown"))


@query("SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'ke khai tai san, thu nhap' WHEN 1 THEN 'ke khai tai san' WHEN 2 THEN 'phieu' END AS key, CASE doc_id % 5 WHEN 0 THEN 'KÊ KHAI TÀI SẢN, THU NHẬP' WHEN 1 THEN 'KÊ KHAI TÀI SẢN' WHEN 2 THEN 'PHIẾU' END AS name FROM documents")
def h52_explicit_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The type that begins a line: the longest, and only before a space, a mark or the end."""
    rest = F.element_at(F.split("text", "\n"), 1)
    head = F.element_at(F.array(*map(F.lit, ("Kê khai tài sản,  thu nhập ", "KÊ KHAI TÀI SẢN (", "Phiếu: ", "Phiếux", "của Quyết định "))), (F.col("doc_id") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", values.explicit_type(F.concat(head, rest)).alias("t")).select("doc_id", "t.key", "t.name")


@query("SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'BẢO CÁO THH' WHEN 1 THEN 'het' ELSE 'Aan x' END AS text FROM customer")
def h18_lookalikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letters that look like Latin ones become Latin."""
    raw = F.element_at(F.array(*map(F.lit, ("BẢО САО".replace("САО", "СÁО") + " ТНН", "нет", "Ααп x".replace("п", "η")))), (F.col("c_custkey") % 3 + 1).cast("int"))
    return table(spark, sf_dir, "customer").select("c_custkey", repair.normalize_lookalikes(raw).alias("text"))


@query("SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN c_name || ' kopyxnm' WHEN 2 THEN '' ELSE c_name END AS text FROM customer")
def h19_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blank where letters of a foreign script remain; letters that look Latin don't."""
    turn = F.col("c_custkey") % 4
    mixed = F.when(turn == 0, "Живот").when(turn == 1, F.concat("c_name", F.lit(" κορυχηм"))).when(turn == 2, F.concat("c_name", F.lit(" ω"))).otherwise(F.col("c_name"))
    return table(spark, sf_dir, "customer").select("c_custkey", repair.sanitize_surface(mixed).alias("text"))


@query(with_archive("SELECT doc_id, pos, unnest(CASE WHEN length(line) > 60 THEN list_filter(string_split(regexp_replace(line, '([.?!])\\s+', '\\1' || chr(10), 'g'), chr(10)), lambda s: s <> '') ELSE [line] END) AS part FROM lines"))
def h47_prepared_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of over 60 characters cut after their sentences."""
    return lines(spark, sf_dir).select("doc_id", "pos", F.explode(C.prepared_lines(F.col("line"), 60)).alias("part"))


@query()
def h46_token_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words in packs of at most 150 tokens, a token for each three characters."""
    words = T.words("text")
    d = table(spark, sf_dir, "documents").select("doc_id", words.alias("w")).withColumn("n", F.transform("w", lambda w: F.ceil(F.length(w) / 3).cast("long")))
    return d.select("doc_id", F.posexplode(C.token_packs(F.col("w"), F.col("n"))).alias("pack", "text")).select("doc_id", "pack", F.sha2("text", 256).alias("sha"), F.length("text").alias("chars"))


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = F.array("x0", "y0", "x1", "y1")
    return lines(spark, sf_dir).select("doc_id", "page", F.col("pos").cast("long").alias("ord"), F.col("line").alias("text"), box.alias("box"), F.when(F.col("pos") % 40 > 35, "foot").alias("region"), F.lit(LINE_HEIGHT).alias("font_size"))


@query()
def h12_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.chunked(_blocks(spark, sf_dir)).select("doc_id", "page", "chunk", "first", "last", "words", "reason")


@query()
def h10_split_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of whole texts by sentences, with overlap."""
    made = per_row(table(spark, sf_dir, "documents").select("doc_id", "text"), lambda t: (C.split_long(t or ""),), "parts array<string>", "text")
    return made.select("doc_id", F.posexplode("parts").alias("part", "text")).select("doc_id", "part", F.size(T.words("text")).alias("words"), F.sha2("text", 256).alias("sha"))


@query()
def e18_distinct_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of a page's lines without those near an earlier one."""
    rows = lines(spark, sf_dir).groupBy("doc_id", "page").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.array("x0", F.col("y0") / 3, "x1", F.col("y1") / 3).alias("b")))), lambda k: k.b).alias("boxes"))
    return rows.select("doc_id", "page", F.size("boxes").alias("all"), F.size(B.distinct_boxes(F.col("boxes"))).alias("kept"))


@query()
def c06_line_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kind of region that each line lies in, near ties by priority."""
    region = lambda kind, *box: F.struct(F.lit(kind).alias("type"), F.array(*map(F.lit, map(float, box))).alias("bbox"))
    regions = F.array(region("text", 0, 0, 595, 500), region("title", 0, 0, 590, 60), region("table", 100, 200, 595, 400), region("page-footer", 0, 480, 595, 600))
    return lines(spark, sf_dir).select("doc_id", "pos", B.region_of(F.array("x0", "y0", "x1", "y1"), regions).alias("type"))


@query()
def e22_visual_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visual lines of the words of a page's first lines."""
    # Lines are gathered as they are, and cut to words in their place: words with boxes are many times the text.
    page = gathered(lines(spark, sf_dir).where("pos < 40"), "doc_id")
    word = lambda k, w, i: F.struct(word_box(k.y0, i, k.pos % 3).alias("box"), (k.pos * 100 + i.cast("long")).alias("ord"))
    pages = page.select("doc_id", F.array_sort(F.flatten(F.transform("x", lambda k: F.transform(line_parts(k.line), lambda w, i: word(k, w, i))))).alias("words"))
    return B.grouped_lines(pages, "words").select("doc_id", F.inline("places")).select("doc_id", "ord", "line", "word")


_WORDS = "SELECT doc_id, pos, y0, unnest(list_transform(range(1, least(40, len(w)) + 1), lambda i: {'text': w[i], 'i': i - 1})) AS x FROM (SELECT doc_id, pos, y0, list_filter(string_split(line, ' '), lambda s: s <> '') AS w FROM lines)"


@query(with_archive(f"SELECT doc_id, pos, x.text AS text, x.i::BIGINT AS ord FROM ({_WORDS}) WHERE x.i * 30.0::DOUBLE + 28 >= 110.0::DOUBLE AND x.i * 30.0::DOUBLE <= 290.0::DOUBLE AND y0 + 12 >= 90.0::DOUBLE AND y0 <= 210.0::DOUBLE"))
def c05_words_in_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that touch the region (125, 100, 275, 200) grown by a tenth of its sides."""
    region = F.array(*map(F.lit, (125.0, 100.0, 275.0, 200.0)))
    return line_words(spark, sf_dir).select("doc_id", "pos", F.inline(B.words_in_region(F.col("words"), region))).select("doc_id", "pos", "text", "ord")


@query(with_archive("SELECT doc_id, pos, array_to_string(w[a + 1 : a + n], ' ') AS text, a * 30.0::DOUBLE AS x0, (a + n - 1) * 30.0::DOUBLE + 28 AS x1 FROM (SELECT doc_id, pos, w, a, unnest(range(1, least(5, len(w) - a + 1))) AS n FROM (SELECT doc_id, pos, w, unnest(range(len(w))) AS a FROM (SELECT doc_id, pos, list_filter(string_split(line, ' '), lambda s: s <> '')[1:40] AS w FROM lines)))"))
def g08_word_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every run of up to four words of a line, with its box."""
    rows = B.word_windows(line_words(spark, sf_dir).select("doc_id", "pos", "words"), "words", 4)
    return rows.select("doc_id", "pos", F.inline("windows")).select("doc_id", "pos", "text", F.col("box")[0].alias("x0"), F.col("box")[2].alias("x1"))


def _matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.transform("words", lambda w: F.struct(w.token.alias("token"), w.box.alias("box")))
    return line_words(spark, sf_dir).select("doc_id", "pos", words.alias("words"), F.array(*map(F.lit, (0.0, 0.0, 600.0, 600.0))).alias("box"))


@query()
def j12_match_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of a phrase in each line, as it is and with edits."""
    found = B.matched_boxes(_matches(spark, sf_dir).withColumn("q", F.lit("licensed under")), "q", "words", "box")
    return found.where((F.size("exact") > 0) | (F.size("near") > 0)).select("doc_id", "pos", F.size("exact").alias("exact"), F.size("near").alias("near"))


@query()
def j13_hydrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first twenty-four results that ask for boxes get them."""
    pages = _matches(spark, sf_dir).select(F.col("doc_id").cast("string").alias("file"), F.col("pos").alias("page"), "words")
    first = lines(spark, sf_dir).where("pos < 2")
    results = first.select(
        (F.col("doc_id") * 2 + F.col("pos")).alias("ord"), F.when(F.col("doc_id") % 2 == 0, "exact").otherwise("fuzzy").alias("match_kind"), F.when(F.col("doc_id") % 7 == 0, "metadata").otherwise("body").alias("chunk_type"), F.lit("the").alias("query"),
        F.col("doc_id").cast("string").alias("file"), F.col("pos").alias("page"), F.array(*map(F.lit, (0.0, 0.0, 600.0, 600.0))).alias("box"), F.lit(None).cast("array<array<double>>").alias("match_boxes"), F.lit(0).alias("match_count"), F.lit(0.5).alias("score"),
    )
    return B.hydrated(results, pages).select("ord", "match_kind", "match_count", "score")


def _tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page for each document with lines of cells: its tables, a second detector's, layout boxes, fragments of text."""
    rows = lines(spark, sf_dir).where(F.contains("line", F.lit(" |"))).select("doc_id", "pos", F.transform(F.split("line", r"\|"), lambda c: F.trim(c)).alias("cells"))
    cols, y = F.size("cells"), F.col("pos") % 40 * 14.0
    boxes = F.transform(F.sequence(F.lit(0), cols - 1), lambda i: F.array(i * 60.0, y, i * 60.0 + 58, y + 12))
    own = rows.select("doc_id", "pos", "cells", boxes.alias("boxes"))
    pages = own.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "cells", "boxes"))).alias("x"))
    every = F.flatten(F.transform("x", lambda r: r.boxes))
    one = F.struct(F.size("x").alias("rows"), F.array_max(F.transform("x", lambda r: F.size(r.cells))).alias("cols"), F.transform("x", lambda r: r.cells).alias("cells"), F.transform("x", lambda r: r.boxes).alias("cell_boxes"), B.union(every).alias("box"))
    half = F.slice("x", 1, F.greatest(F.lit(1), F.floor(F.size("x") / 2).cast("int")))
    two = F.struct(F.size(half).alias("rows"), F.lit(2).alias("cols"), F.transform(half, lambda r: F.slice(r.cells, 1, 2)).alias("cells"), F.transform(half, lambda r: F.slice(r.boxes, 1, 2)).alias("cell_boxes"), B.union(F.flatten(F.transform(half, lambda r: r.boxes))).alias("box"))
    text = F.transform(every, lambda b: F.struct(F.lit("x").alias("text"), b.alias("box")))
    return pages.select("doc_id", F.array(one).alias("first"), F.array(two).alias("second"), F.array(B.union(every)).alias("layout"), every.alias("fragments"), text.alias("texts"))


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return TB.measured(_tables(spark, sf_dir), "first", "layout", "fragments")


@query()
def g24_split_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir).select("doc_id", F.inline("parts")).select("doc_id", "rows", "cols")


@query()
def i33_text_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir).select("doc_id", F.round(F.get("fits", F.lit(0)), 6).alias("fit"))


@query()
def i34_table_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir).select("doc_id", F.round(F.get("scores", F.lit(0)), 6).alias("score"))


@query()
def i35_set_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir).select("doc_id", F.round("set_score", 6).alias("score"))


@query()
def i36_chosen_detector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return TB.chosen(_tables(spark, sf_dir), "first", "second", "layout", "fragments").select("doc_id", "second_chosen")


@query()
def c07_cell_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of each table filled from the page's fragments."""
    rows = _tables(spark, sf_dir).select("doc_id", F.get("first", F.lit(0)).alias("t"), "texts")
    return TB.matched_text(rows, "t", "texts").select("doc_id", "assigned", "orphan", "weak", F.size("filled").alias("rows"))


@query(with_archive("""SELECT doc_id, pos, CASE WHEN NOT (cx BETWEEN 100 - 4 AND 500 + 4 AND cy BETWEEN 50 - 4.5::DOUBLE AND 500 + 4.5::DOUBLE) OR (x1 - x0) * (y1 - y0) <= 0 THEN NULL
  WHEN w * h <= 0 AND NOT inside THEN CASE WHEN sqrt(dx * dx + dy * dy) <= 1.25::DOUBLE THEN round(0.12::DOUBLE - sqrt(dx * dx + dy * dy) * 0.05::DOUBLE, 6) END
  ELSE round(w * h / f * 3 + w * h / (f + 20000 - w * h) + w / (x1 - x0) * 0.35::DOUBLE + h / (y1 - y0) * 0.35::DOUBLE + CASE WHEN inside THEN 0.75::DOUBLE ELSE 0 END, 6) END AS score
FROM (SELECT *, (x1 - x0) * (y1 - y0) AS f, cx BETWEEN 100 AND 300 AND cy BETWEEN 100 AND 200 AS inside, greatest(0, least(x1, 300.0::DOUBLE) - greatest(x0, 100.0::DOUBLE)) AS w, greatest(0, least(y1, 200.0::DOUBLE) - greatest(y0, 100.0::DOUBLE)) AS h, (cx - 200) / 200.0::DOUBLE AS dx, (cy - 150) / 100.0::DOUBLE AS dy
  FROM (SELECT *, (x0 + x1) / 2 AS cx, (y0 + y1) / 2 AS cy FROM lines))"""))
def c08_cell_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well each line fits a cell (100, 100, 300, 200) of a table (100, 50, 500, 500)."""
    cell, whole = [100.0, 100.0, 300.0, 200.0], [100.0, 50.0, 500.0, 500.0]

    def of(*box: float) -> tuple:
        score = TB.cell_match(list(box), cell, whole)
        return (None if score is None else round(score, 6),)

    return per_row(lines(spark, sf_dir), of, "score double", "x0", "y0", "x1", "y1").select("doc_id", "pos", "score")


_TAG = "CASE WHEN {c} = 'R' THEN 'O' WHEN {k} % 2 = 0 THEN 'B-' || {c} ELSE 'I-' || {c} END"
_EACH = "SELECT regexp_replace(" + _TAG.format(c="l_returnflag", k="l_linenumber") + ", '^[BI]-', '') AS g, regexp_replace(" + _TAG.format(c="CASE l_linestatus WHEN 'F' THEN 'A' ELSE 'R' END", k="l_linenumber") + ", '^[BI]-', '') AS p FROM lineitem"


@query(f"WITH x AS ({_EACH}), y AS (SELECT g AS field, 1 AS gold, 0 AS pred, 0 AS tp, 0 AS fp, (g <> p)::INT AS fn FROM x UNION ALL SELECT p, 0, 1, (g = p)::INT, (g <> p)::INT, 0 FROM x) SELECT field, sum(gold)::BIGINT AS gold, sum(pred)::BIGINT AS pred, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM y WHERE field <> 'O' GROUP BY ROLLUP (field)")
def d19_word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words right, wrong and missed by field and overall, an order's lines as one row of tags."""
    tag = lambda c: F.when(c == "R", F.lit("O")).otherwise(F.concat(F.when(F.col("l_linenumber") % 2 == 0, "B-").otherwise("I-"), c))
    item = F.struct("l_linenumber", tag(F.col("l_returnflag")).alias("g"), tag(F.when(F.col("l_linestatus") == "F", "A").otherwise("R")).alias("p"))
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(item)).alias("x"))
    return K.word_counts(rows.select(F.transform("x", lambda i: i.g).alias("g"), F.transform("x", lambda i: i.p).alias("p")), "g", "p")


@query()
def d21_span_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of an order's lines by supplier, against the same spans with some lines left out."""
    span = lambda ids: F.array(F.struct(F.array_sort(ids).alias("word_ids"), F.array(*map(F.lit, (0.0, 0.0, 10.0, 10.0))).alias("box")))
    items = table(spark, sf_dir, "lineitem")
    line = F.col("l_linenumber").cast("string")
    rows = items.groupBy("l_orderkey", F.col("l_returnflag").alias("field")).agg(span(F.collect_list(line)).alias("gold"), span(F.collect_list(F.when(F.col("l_quantity") > 10, line))).alias("pred"))
    return K.span_metrics(rows, "gold", "pred").select("field", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "exact", "missing_rate", "extra_rate", "mean_iou")])


@query()
def d18_tuned_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thresholds of each flag on the discount that best tell dear lines."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("field"), F.col("l_quantity").alias("score"), (F.col("l_extendedprice") > 30000).alias("gold"))
    grid = [float(x) for x in range(5, 50, 5)]
    found, best = K.tuned_thresholds(lambda settings: K.threshold_objectives(rows, settings), dict.fromkeys("ANR", 25.0), dict.fromkeys("ANR", grid))
    return spark.createDataFrame([(f, v, round(best, 9)) for f, v in found.items()], "field string, threshold double, objective double")


@query("SELECT doc_id, pages, path FROM (SELECT *, CASE WHEN pages > 1 AND r <= 3 THEN 0 WHEN pages <= 1 THEN 1 ELSE 2 END AS kind FROM (SELECT *, row_number() OVER (PARTITION BY pages > 1 ORDER BY pages, path) AS r FROM (SELECT doc_id, (1 + n_chars // 4000)::BIGINT AS pages, lang || '/' || lpad(doc_id::VARCHAR, 9, '0') AS path FROM documents))) ORDER BY kind, pages, path LIMIT 20")
def d39_selected_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty documents: three of several pages, then those of one page, then others."""
    d = table(spark, sf_dir, "documents").select("doc_id", (1 + F.floor(F.col("n_chars") / 4000)).alias("pages"), F.concat("lang", F.lit("/"), F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("path"))
    return K.selected_documents(d, 20, 3)


@query("SELECT import_id, source, status FROM (SELECT event_id AS import_id, event_type AS source, 'done' AS status FROM events UNION ALL SELECT (SELECT max(event_id) FROM events) + 1, 'new', 'running')")
def k03_begun_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The history of imports with one that begins."""
    history = table(spark, sf_dir, "events").select(F.col("event_id").alias("import_id"), F.col("event_type").alias("source"), F.lit(0).cast("long").alias("started_at"), F.lit("done").alias("status"))
    return merge.begun(history, "new", 1).select("import_id", "source", "status")


@query("SELECT user_id AS session, (event_id % 7)::BIGINT AS page, max_by(event_type, (ts, event_id)) AS result FROM events GROUP BY 1, 2")
def l06_cached_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last result of each page of a session."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("session"), (F.col("event_id") % 7).alias("page"), F.col("event_type").alias("result"), "ts", "event_id")
    return merge.latest(e, ["session", "page"], [F.desc("ts"), F.desc("event_id")]).select("session", "page", "result")


@query("SELECT lang, count(*)::BIGINT AS n FROM documents WHERE lang IN ('en', 'fr') GROUP BY lang")
def b07_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filters apply only if some are set."""
    filters = {"lang": ["en", "fr"], "source": "", "year": None}
    d = table(spark, sf_dir, "documents")
    chosen = d.where(F.col("lang").isin(filters["lang"])) if values.is_active(filters) and not values.is_active({"source": "", "year": None}) else d
    return chosen.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, n::BIGINT AS n FROM (SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(" + sql_fold("text") + ", '[\\p{L}\\p{N}_]+')) FROM documents) GROUP BY doc_id)")
def j04_committed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index written as a new version and read back, the last version only."""
    index = table(spark, sf_dir, "documents").select("doc_id", F.size(T.tokens("text")).cast("long").alias("n")).where("n > 0")
    return merge.committed(index, merge.scratch(spark, "index"))
