"""Spatial matching, pairing, type and date queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geometry as G
from ..functions import text as T
from ..operators import greedy
from ..operators import measures as M
from .bindings import lines, table, with_archive
from .pagequeries import BY, PAGES, planted
from .registry import query

#: Cells of a page's grid: four columns of 150 by eight rows of 70.
COLUMNS, ROWS, WIDE, HIGH = 4, 8, 150.0, 70.0
_CELLS = f"(SELECT r.r, c.c, c.c * {WIDE}::DOUBLE AS bx0, r.r * {HIGH}::DOUBLE AS by0, (c.c + 1) * {WIDE}::DOUBLE AS bx1, (r.r + 1) * {HIGH}::DOUBLE AS by1 FROM (SELECT unnest(range({ROWS}))::INT AS r) r, (SELECT unnest(range({COLUMNS}))::INT AS c) c)"
_CUT = "greatest(0.0, least(x1, bx1) - greatest(x0, bx0)) * greatest(0.0, least(y1, by1) - greatest(y0, by0))"
_AREA = "(x1 - x0) * (y1 - y0)"


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line with the cells of its page: a fixed number for each line, no join."""
    own = lines(spark, sf_dir).select("doc_id", "pos", *[F.col(s).alias(f"a{s}") for s in G.SIDES])
    grid = own.select("*", F.explode(F.sequence(F.lit(0), F.lit(ROWS - 1))).alias("r")).select("*", F.explode(F.sequence(F.lit(0), F.lit(COLUMNS - 1))).alias("c"))
    return grid.withColumns({"bx0": F.col("c") * WIDE, "by0": F.col("r") * HIGH, "bx1": (F.col("c") + 1) * WIDE, "by1": (F.col("r") + 1) * HIGH})


def _score() -> Column:
    """Three parts of coverage, one of the union's share, and a bonus for a centre inside."""
    cx, cy = (F.col("ax0") + F.col("ax1")) / 2, (F.col("ay0") + F.col("ay1")) / 2
    inside = cx.between(F.col("bx0"), F.col("bx1")) & cy.between(F.col("by0"), F.col("by1"))
    return F.round(3 * G.coverage("a", "b") + G.iou("a", "b") + F.when(inside, 0.5).otherwise(0.0), 6)


_SCORED = f"(SELECT doc_id, pos, r, c, round(3 * CASE WHEN {_AREA} > 0 THEN {_CUT} / ({_AREA}) ELSE 0 END + {_CUT} / ({_AREA} + (bx1 - bx0) * (by1 - by0) - {_CUT}) + CASE WHEN (x0 + x1) / 2 BETWEEN bx0 AND bx1 AND (y0 + y1) / 2 BETWEEN by0 AND by1 THEN 0.5::DOUBLE ELSE 0 END, 6) AS score FROM lines, {_CELLS})"




@query(with_archive("SELECT a.doc_id, a.pos FROM lines a WHERE a.pos % 2 = 1 AND NOT EXISTS (SELECT 1 FROM lines b WHERE b.doc_id = a.doc_id AND b.pos = a.pos - 1 AND least(a.x1, b.x1 + 9) - greatest(a.x0, b.x0) >= 0.55::DOUBLE * (a.x1 - a.x0))"))
def c09_uncovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that the one before doesn't cover enough: an anti join on the neighbour's place."""
    own = lines(spark, sf_dir)
    before = own.select("doc_id", (F.col("pos") + 1).alias("pos"), F.col("x0").alias("b0"), (F.col("x1") + 9).alias("b1"))
    both = own.where("pos % 2 = 1").join(before, ["doc_id", "pos"], "left")
    covered = F.least("x1", "b1") - F.greatest("x0", "b0") >= 0.55 * (F.col("x1") - F.col("x0"))
    return both.where(~F.coalesce(covered, F.lit(False))).select("doc_id", "pos")


@query(f"{PAGES}\nSELECT a.doc_id, a.page, a.ord AS role_ord, b.ord AS name_ord, round((b.y0 - a.y0) + 0.25::DOUBLE * abs(b.x0 - a.x0), 6) AS distance FROM scored a JOIN scored b ON a.doc_id = b.doc_id AND a.page = b.page WHERE a.role AND b.name_score > 0 AND b.y0 - a.y0 BETWEEN 0.0001 AND 0.2")
def c13_signer_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles and the names a little below them, with a distance."""
    from ..operators.pages import line_scores

    scored = line_scores(planted(spark, sf_dir), BY)
    a = scored.where("role").select(*BY, F.col("ord").alias("role_ord"), F.col("y0").alias("ay"), F.col("x0").alias("ax"))
    b = scored.where("name_score > 0").select(*BY, F.col("ord").alias("name_ord"), F.col("y0").alias("by"), F.col("x0").alias("bx"))
    gap = F.col("by") - F.col("ay")
    return a.join(b, BY).where(gap.between(0.0001, 0.2)).select(*BY, "role_ord", "name_ord", F.round(gap + 0.25 * F.abs(F.col("bx") - F.col("ax")), 6).alias("distance"))


@query()
def c12_linked_signers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each role takes the nearest free name."""
    pairs = c13_signer_pairs(spark, sf_dir).withColumn("sheet", F.concat_ws("/", F.col("doc_id").cast("string"), F.col("page").cast("string")))
    return greedy.matched(pairs.withColumn("near", 1.0 / (1.0 + F.col("distance"))).select("sheet", F.col("role_ord").cast("long").alias("role_ord"), F.col("name_ord").cast("long").alias("name_ord"), "near"), "sheet", "role_ord", "name_ord", "near")




@query(with_archive("SELECT doc_id, page, round_even(min(x0), 2) AS x0, round_even(min(y0), 2) AS y0, round_even(max(x1) / 3, 2) AS x1, round_even(max(y1) / 3, 2) AS y1 FROM lines GROUP BY doc_id, page"))
def g16_merged_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = lambda c: F.bround(c, 2)
    return lines(spark, sf_dir).groupBy("doc_id", "page").agg(cut(F.min("x0")).alias("x0"), cut(F.min("y0")).alias("y0"), cut(F.max("x1") / 3).alias("x1"), cut(F.max("y1") / 3).alias("y1"))


@query("SELECT doc_id, CASE WHEN r <= n // 10 THEN 'val' WHEN r <= 2 * (n // 10) THEN 'test' ELSE 'train' END AS split FROM (SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY md5('9:' || doc_id), doc_id) AS r, count(*) OVER (PARTITION BY source) AS n FROM documents)")
def g21_split_by_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slices of a seeded hash order, within each source so that no task orders the table."""
    w = Window.partitionBy("source")
    r = F.row_number().over(w.orderBy(F.md5(F.concat(F.lit("9:"), F.col("doc_id").cast("string"))), "doc_id"))
    d = table(spark, sf_dir, "documents").select("doc_id", r.alias("r"), F.floor(F.count(F.lit(1)).over(w) / 10).alias("n"))
    return d.select("doc_id", F.when(F.col("r") <= F.col("n"), "val").when(F.col("r") <= 2 * F.col("n"), "test").otherwise("train").alias("split"))


_TYPES = ("Quyết định", "Báo cáo", "Tờ trình", "Kế hoạch")


@query("SELECT o_orderkey, (['Quyết định', 'Báo cáo', 'Tờ trình', 'Kế hoạch', NULL])[o_orderkey % 5 + 1] AS doc_type FROM orders")
def h24_type_of_subject(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The type whose name begins a subject."""
    subject = F.when(F.col("o_orderkey") % 5 < 4, F.concat(F.upper(F.element_at(F.array(*map(F.lit, _TYPES)), (F.least(F.col("o_orderkey") % 5, F.lit(3)) + 1).cast("int"))), F.lit(" về việc mua sắm"))).otherwise(F.lit("Thư ngỏ"))
    names = F.array(*[F.struct(F.lit(T._plain(n)).alias("k"), F.lit(n).alias("n")) for n, _ in T.DOC_TYPES])
    found = F.filter(names, lambda x: F.startswith(F.concat(T.fold(subject), F.lit(" ")), F.concat(x["k"], F.lit(" "))))
    longest = F.array_sort(found, lambda a, b: F.length(b["k"]) - F.length(a["k"]))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.size(found) > 0, F.element_at(longest, 1)["n"]).alias("doc_type"))


@query("SELECT o_orderkey, o_orderkey::VARCHAR || '/QD' AS symbol FROM orders")
def h27_prefix_stripped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The word before a number goes, in any of its spellings."""
    prefix = F.element_at(F.array(*map(F.lit, ("Số: ", "Số ", "SỐ:", ""))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    text = F.concat(prefix, F.col("o_orderkey").cast("string"), F.lit("/QD"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.regexp_replace(text, r"(?iu)^\s*s[ốoô][\s:.]*", "").alias("symbol"))



@query(with_archive("SELECT doc_id, pos, (CASE WHEN gap > 14 THEN 2 ELSE 0 END + CASE WHEN before < 300 THEN 1 ELSE 0 END - CASE WHEN regexp_matches(line, '^[a-z]') THEN 2 ELSE 0 END + CASE WHEN regexp_matches(line, '^[A-Z]') THEN 1 ELSE 0 END)::INT AS score FROM (SELECT *, coalesce(y0 - lag(y0) OVER w, 0) AS gap, coalesce(lag(x1) OVER w, 0) AS before FROM lines WINDOW w AS (PARTITION BY doc_id, page ORDER BY pos))"))
def i37_paragraph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence that a paragraph begins with a line: gap, short line before, case of its first letter."""
    w = Window.partitionBy("doc_id", "page").orderBy("pos")
    own = lines(spark, sf_dir).withColumn("gap", F.coalesce(F.col("y0") - F.lag("y0").over(w), F.lit(0.0))).withColumn("before", F.coalesce(F.lag("x1").over(w), F.lit(0.0)))
    points = lambda c, n: F.when(c, n).otherwise(0)
    return own.select("doc_id", "pos", (points(F.col("gap") > 14, 2) + points(F.col("before") < 300, 1) - points(F.col("line").rlike("^[a-z]"), 2) + points(F.col("line").rlike("^[A-Z]"), 1)).alias("score"))



@query("SELECT l_orderkey, coalesce(arg_min(l_returnflag, l_linenumber * 1000000 + l_partkey) FILTER (WHERE l_returnflag <> 'N'), 'N') AS tag FROM lineitem GROUP BY l_orderkey")
def m20_first_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of overlapping predictions the first that is not empty."""
    first = F.min_by(F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")), F.when(F.col("l_returnflag") != "N", F.col("l_linenumber") * 1000000 + F.col("l_partkey")))
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.coalesce(first, F.lit("N")).alias("tag"))



@query("SELECT l_orderkey, l_returnflag, page FROM (SELECT l_orderkey, l_returnflag, l_linestatus AS page, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY round(sum(l_tax), 6) DESC, count(*) DESC, l_linestatus) AS r FROM lineitem GROUP BY 1, 2, 3) WHERE r = 1")
def f05_best_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page of each field by the sum of its spans, then their number."""
    pages = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_returnflag", F.col("l_linestatus").alias("page")).agg(F.round(F.sum("l_tax"), 6).alias("s"), F.count(F.lit(1)).alias("n"))
    return M.top_k(pages, ["l_orderkey", "l_returnflag"], [F.col("s").desc(), F.col("n").desc(), F.col("page")], 1).select("l_orderkey", "l_returnflag", "page")
