"""Field extraction over planted pages of 595 by 842 points: the driver's lines with headings and signatures in their place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import extract as E
from .bindings import sql_fold
from .pagequeries import PAGES, planted
from .registry import query

WIDTH, HEIGHT = 595.0, 842.0
#: The planted lines as boxes on the page; SQL for the oracles.
LINES = PAGES + ", boxes AS (SELECT doc_id, page, ord, text, x0 * 595.0::DOUBLE AS x, y0 * 842.0::DOUBLE AS y, (x1 - x0) * 595.0::DOUBLE AS w FROM planted)"
TOP = "y < 842.0::DOUBLE * 0.35::DOUBLE"


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with their lines in order; every fifth line is bold, and the seventh of a page a signature."""
    line = F.struct(
        "text", (F.col("x0") * WIDTH).alias("x"), (F.col("y0") * HEIGHT).alias("y"), ((F.col("x1") - F.col("x0")) * WIDTH).alias("w"), F.lit(12.0).alias("h"),
        F.when(F.col("ord") % 40 == 7, E.SIGNATURE).cast("int").alias("content_type"), F.when(F.col("ord") % 5 == 0, 20).otherwise(128).alias("fg_gray"), F.floor(F.col("ord") / 3).cast("int").alias("block_id"),
    )
    rows = planted(spark, sf_dir).groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("ord", line.alias("line")))).alias("x"))  # at most 40 lines
    region = F.array(F.struct(F.lit("title").alias("type"), F.array(*map(F.lit, (0.0, 0.0, 300.0, 120.0))).alias("bbox")))
    return rows.select("doc_id", "page", F.lit(WIDTH).alias("width"), F.lit(HEIGHT).alias("height"), F.transform("x", lambda k: k.line).alias("lines"), region.alias("regions"))


def _each(spark: SparkSession, sf_dir: str, **fields: Column) -> DataFrame:
    return pages(spark, sf_dir).select("doc_id", "page", *[c.alias(n) for n, c in fields.items()])


_PLAIN = f"replace(upper({sql_fold('text')}), ' ', '')"


@query(f"{LINES} SELECT doc_id, page, coalesce(arg_min(kind, ord) FILTER (kind IS NOT NULL), 'unknown') AS doc_type FROM (SELECT *, CASE WHEN contains({_PLAIN}, 'DANGCONGSAN') THEN 'dang' WHEN contains({_PLAIN}, 'CONGHOAXAHOICHUNGHIAVIETNAM') OR contains({_PLAIN}, 'DOCLAP-TUDO-HANHPHUC') THEN 'nhanuoc' END AS kind FROM boxes) GROUP BY doc_id, page")
def m13_issuer_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Party or state by the first line that names one."""
    return _each(spark, sf_dir, doc_type=E.kind_of_issuer(F.col("lines")))


def _number_sql() -> str:
    word = "[\\p{L}\\p{N}_\\-–—/]+"
    patterns = ("S[oố]\\s*[:\\s]*([0-9]+\\s*[\\-–—]\\s*[A-Za-zĐđÀ-ỹ]+\\s*/\\s*[A-Za-zĐđÀ-ỹ]+)", f"S[oố]\\s*[:\\s]+([0-9]+\\s*/\\s*{word})", f"S[oố]\\s*[:\\s]*([0-9]+[\\s\\-–—/]+{word})")
    tries = ", ".join(f"arg_min(nullif(regexp_extract(text, '{p}', 1, 'i'), ''), ord) FILTER ({TOP} AND regexp_extract(text, '{p}', 1, 'i') <> '')" for p in patterns)
    return f"{LINES} SELECT doc_id, page, 'Số ' || regexp_replace(trim(coalesce({tries})), '\\s*([/\\-–—])\\s*', '\\1', 'g') AS number FROM boxes GROUP BY doc_id, page"


@query(_number_sql())
def m14_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number and symbol of a page, the party's pattern first."""
    return _each(spark, sf_dir, number=E.number_and_symbol(F.col("lines"), F.col("height"), state=False))


_DATE = "ng[aàáảãạ]y\\s+[0-9]{1,2}\\s+th[aáàảãạ]ng\\s+[0-9]{1,2}\\s+n[aăâ]m\\s+[0-9]{4}"


@query(f"{LINES} SELECT doc_id, page, coalesce(arg_min(trim(regexp_extract(text, '(.*?{_DATE})', 1, 'i')), ord) FILTER ({TOP} AND regexp_matches(text, '{_DATE}', 'i')), arg_min(trim(text), ord) FILTER ({TOP} AND regexp_matches({sql_fold('text')}, 'ngay\\s+[0-9]{{1,2}}\\s+thang\\s+[0-9]{{1,2}}\\s+nam\\s+[0-9]{{4}}'))) AS issue_date FROM boxes GROUP BY doc_id, page")
def m15_issue_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _each(spark, sf_dir, issue_date=E.issue_date(F.col("lines"), F.col("height")))


def _signer_sql() -> str:
    t = "regexp_replace(text, '^\\s+|\\s+$', '', 'g')"
    roles = " OR ".join(f"contains(upper({t}), '{r}')" for r in E.ROLES)
    none = " OR ".join(f"contains(upper({t}), '{r}')" for r in E.NO_NAME)
    name = f"regexp_matches({t}, '^[A-ZÀ-Ỹ][a-zà-ỹ]+(\\s+[A-ZÀ-Ỹ][a-zà-ỹ]+){{1,4}}$')"
    words = f"list_filter(regexp_split_to_array({t}, '\\s+'), lambda w: w <> '')"
    capitals = f"(NOT regexp_matches({t}, '[0-9.,:;!?()\\[\\]/\\\\]') AND len({words}) BETWEEN 2 AND 5 AND len(list_filter({words}, lambda w: NOT regexp_matches(w, '^\\p{{Lu}}'))) = 0 AND NOT ({none}))"
    return f"""{LINES}, low AS (SELECT doc_id, page, ord, {t} AS t, y, x + w / 2 AS centre, ord % 40 = 7 AS signed, {roles} AS role, {name} AS named, length({t}) >= 4 AND NOT ({roles}) AND ({name} OR {capitals}) AS may FROM boxes WHERE y > 842.0::DOUBLE * 0.6::DOUBLE),
marked AS (SELECT *, min(y) FILTER (signed) OVER (PARTITION BY doc_id, page) AS mark FROM low),
best AS (SELECT doc_id, page, coalesce(arg_min(t, (y, ord)) FILTER (y > mark AND y - mark < 50 AND named AND NOT role), arg_min(t, (-y, ord)) FILTER (may AND centre > 595.0::DOUBLE * 0.45::DOUBLE), arg_min(t, (-y, ord)) FILTER (may)) AS signer FROM marked GROUP BY doc_id, page)
SELECT p.doc_id, p.page, b.signer FROM (SELECT DISTINCT doc_id, page FROM boxes) p LEFT JOIN best b ON p.doc_id = b.doc_id AND p.page = b.page"""


@query(_signer_sql())
def m16_signers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The signer of each page by name, place and signature."""
    return _each(spark, sf_dir, signer=E.signer(F.col("lines"), F.col("width"), F.col("height")))


@query()
def m17_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The subject of each page, with the lines that carry it on."""
    return _each(spark, sf_dir, subject=E.subject(F.col("lines"), F.col("height"), F.col("regions")))


@query()
def m12_document_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All header fields, the signer and the type of each document."""
    return E.document_fields(pages(spark, sf_dir))
