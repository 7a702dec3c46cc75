"""Page scores over planted pages: the driver's lines with headings and signatures put in their place."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import measures as M
from ..operators import pages as P
from .bindings import lines, sql_fold, with_archive
from .registry import query

#: Lines that stand at some places of a page, by turn; of the others the driver's own text stays.
PLANTED = (
    "CỘNG HÒA XÃ HỘI CHỦ NGHĨA VIỆT NAM", "Độc lập - Tự do - Hạnh phúc", "Số: 12/QĐ-UBND", "Hà Nội, ngày 5 tháng 6 năm 2024", "QUYẾT ĐỊNH", "Về việc ban hành quy chế", "Nơi nhận: phòng Nội vụ",
    "TM. ỦY BAN NHÂN DÂN", "CHỦ TỊCH", "Nguyễn Văn An", "(theo công văn số 45/CV-BTC ngày 1 tháng 2 năm 2023)", "ĐẢNG ỦY XÃ", "Phụ lục kèm theo",
)
BY = ["doc_id", "page"]


def planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    turn = ((F.col("pos") + F.col("doc_id") * 7) % 26).cast("int")
    text = F.when(turn < len(PLANTED), F.get(F.array(*map(F.lit, PLANTED)), turn)).otherwise(F.col("line"))
    x = (turn % 5) * 0.12
    return lines(spark, sf_dir).select("doc_id", "page", F.col("pos").alias("ord"), text.alias("text"), x.alias("x0"), (F.col("pos") % 40 / 40.0).alias("y0"), (x + 0.3 + turn % 3 * 0.15).alias("x1"))


def _sql() -> str:
    def contains(words: tuple[str, ...]) -> str:
        return "(" + " OR ".join(f"contains(n, '{w}')" for w in words) + ")"

    pts = lambda c, p: f"CASE WHEN {c} THEN {p}::DOUBLE ELSE 0 END"
    clamp = lambda e: f"least(1.0::DOUBLE, greatest(0.0::DOUBLE, {e}))"
    re = lambda p: f"regexp_matches(n, '{p}')"
    array = "[" + ", ".join("'" + t + "'" for t in PLANTED) + "]"
    role = contains(P.ROLE_KEYWORDS)
    return f"""
planted AS (SELECT doc_id, page, pos AS ord, CASE WHEN turn < {len(PLANTED)} THEN ({array})[turn + 1] ELSE line END AS text, (turn % 5) * 0.12::DOUBLE AS x0, (pos % 40) / 40.0::DOUBLE AS y0, (turn % 5) * 0.12::DOUBLE + 0.3::DOUBLE + (turn % 3) * 0.15::DOUBLE AS x1
  FROM (SELECT *, ((pos + doc_id * 7) % 26)::INT AS turn FROM lines)),
folded AS (SELECT *, trim(regexp_replace({sql_fold('text')}, '[\\s ]+', ' ', 'g')) AS n, (x0 + x1) / 2 AS cx, greatest(0.0::DOUBLE, x1 - x0) AS width,
  CASE WHEN length(regexp_replace(text, '\\P{{L}}', '', 'g')) > 0 THEN length(regexp_replace(text, '\\P{{Lu}}', '', 'g')) / length(regexp_replace(text, '\\P{{L}}', '', 'g'))::DOUBLE ELSE 0 END AS up FROM planted),
flags AS (SELECT *, contains(n, 'cong hoa xa hoi chu nghia') OR contains(n, 'dang cong san viet nam') AS regime, contains(n, 'doc lap') AND contains(n, 'tu do') AND contains(n, 'hanh phuc') AS motto,
  {re(P.SIGNER)} OR {role} AS role, {pts("starts_with(n, '(') OR ends_with(n, ')')", 0.35)} + {pts('length(n) > 70', 0.25)} + {pts('x1 - x0 > 0.62::DOUBLE', 0.2)} AS penalty,
  {' + '.join(f"contains(n, '{w}')::INT" for w in P.ORG_KEYWORDS)} AS hits, {' + '.join(f"{re(chr(92) + 'b' + w + chr(92) + 'b')}::INT" for w in ('ngay', 'thang', 'nam'))} AS words,
  {re(P.NUMBER)} OR {re(P.SYMBOL)} AS numbered, {re(P.NUMBER_FIRST)} AS first, {re(P.SO_FIRST)} AS so, {re(P.DATE)} AS dated,
  list_filter(regexp_split_to_array(trim(text), '\\s+'), lambda t: t <> '') AS toks FROM folded),
near AS (SELECT *, coalesce(max(role::INT) OVER (PARTITION BY doc_id, page ORDER BY ord ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 0) AS above FROM flags),
scored AS (SELECT *,
  CASE WHEN y0 <= 0.38::DOUBLE AND hits > 0 THEN {clamp(f"0.35::DOUBLE + least(0.3::DOUBLE, hits * 0.12::DOUBLE) + {pts('cx < 0.45::DOUBLE', 0.2)} + {pts('y0 < 0.22::DOUBLE', 0.1)} + {pts('up >= 0.55::DOUBLE', 0.1)}")} ELSE 0 END AS org_score,
  CASE WHEN y0 <= 0.48::DOUBLE AND (numbered OR so) THEN {clamp(f"CASE WHEN first THEN 0.62::DOUBLE WHEN so THEN 0.35 ELSE 0.12 END + {pts(re(P.SYMBOL), 0.22)} + {pts('x0 < 0.34::DOUBLE', 0.1)} + {pts('cx < 0.52::DOUBLE', 0.08)} + CASE WHEN width <= 0.42::DOUBLE THEN 0.1::DOUBLE WHEN width <= 0.56::DOUBLE THEN 0.04 ELSE 0 END + {pts('y0 BETWEEN 0.12::DOUBLE AND 0.44::DOUBLE', 0.06)} - penalty")} END AS number_score,
  CASE WHEN y0 <= 0.5::DOUBLE AND words >= 2 THEN {clamp(f"CASE WHEN dated THEN 0.72::DOUBLE WHEN words >= 3 AND {re(chr(92) + 'b[0-9]{4}' + chr(92) + 'b')} THEN 0.55 ELSE 0.32 END + {pts('cx > 0.45::DOUBLE', 0.12)} + {pts('x0 > 0.32::DOUBLE', 0.08)} + {pts('width <= 0.55::DOUBLE', 0.08)} + {pts('y0 BETWEEN 0.16::DOUBLE AND 0.48::DOUBLE', 0.05)} - penalty")} END AS date_score,
  CASE WHEN y0 BETWEEN 0.16::DOUBLE AND 0.68::DOUBLE AND {contains(P.SUBJECT_KEYWORDS)} THEN {clamp(f"CASE WHEN contains(n, 've viec') THEN 1.0::DOUBLE ELSE 0.75 END + {pts('up >= 0.55::DOUBLE', 0.1)}")} ELSE 0 END AS subject_score,
  CASE WHEN {re(P.RECIPIENTS)} THEN CASE WHEN y0 > 0.55::DOUBLE THEN 1.0::DOUBLE WHEN y0 > 0.35::DOUBLE THEN 0.9 ELSE 0.7 END ELSE 0 END AS recipients_score,
  CASE WHEN y0 >= 0.3::DOUBLE AND role THEN {clamp(f"{pts(re(P.SIGNER), 0.55)} + {pts(role, 0.35)} + {pts('y0 > 0.45::DOUBLE', 0.08)} + {pts('cx > 0.4::DOUBLE', 0.05)}")} ELSE 0 END AS role_score,
  CASE WHEN y0 <= 0.56::DOUBLE AND (numbered OR dated) AND NOT first THEN greatest(CASE WHEN penalty > 0 THEN least(1.0::DOUBLE, 0.45 + penalty) ELSE 0 END, {pts('length(n) > 85', 0.65)}) ELSE 0 END AS reference_score,
  CASE WHEN y0 >= 0.34::DOUBLE AND NOT {re('[0-9]')} AND NOT {re(P.RECIPIENTS)} AND NOT role AND len(toks) BETWEEN 2 AND 5 AND len(list_filter(toks, lambda t: length({sql_fold('t')}) <= 1)) = 0 THEN {clamp(f"CASE WHEN up >= 0.55::DOUBLE THEN 0.4::DOUBLE WHEN len(list_filter(toks, lambda t: regexp_matches(left(t, 1), '{chr(92)}p{{Lu}}'))) >= greatest(2, len(toks) - 1) THEN 0.28 ELSE 0 END + {pts(f'{sql_fold(chr(116) + chr(111) + chr(107) + chr(115) + chr(91) + chr(49) + chr(93))} IN {P.SURNAMES}', 0.3)} + {pts('above = 1', 0.25)} + {pts('y0 > 0.45::DOUBLE', 0.05)} + {pts('cx > 0.35::DOUBLE', 0.05)}")} ELSE 0 END AS name_score
  FROM near),
pages0 AS (SELECT doc_id, page, {clamp(f"{pts('max((y0 < 0.34::DOUBLE AND regime)::INT) = 1', 0.7)} + {pts('max((y0 < 0.34::DOUBLE AND motto)::INT) = 1', 0.3)} + {pts('max((y0 < 0.34::DOUBLE AND cx > 0.42::DOUBLE AND (regime OR motto))::INT) = 1', 0.1)}")} AS regime_score,
  max(org_score) AS org_score, coalesce(max(number_score), 0) AS number_score, coalesce(max(date_score), 0) AS date_score, max(subject_score) AS subject_score, max(recipients_score) AS recipients_score, max(role_score) AS role_score, max(reference_score) AS reference_score, max(name_score) AS name_score FROM scored GROUP BY doc_id, page),
nums AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY number_score DESC, ord) AS r FROM scored WHERE number_score >= 0.45::DOUBLE) WHERE r <= 3),
dates AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY date_score DESC, ord) AS r FROM scored WHERE date_score >= 0.45::DOUBLE) WHERE r <= 3),
pairs AS (SELECT a.doc_id, a.page, max({clamp(f"0.55::DOUBLE + {pts('a.x0 < 0.38::DOUBLE AND b.x0 > 0.3::DOUBLE', 0.25)} + {pts('abs(a.y0 - b.y0) <= 0.045::DOUBLE', 0.15)} + 0.05::DOUBLE * least(a.number_score, b.date_score)")}) AS alignment_score FROM nums a JOIN dates b ON a.doc_id = b.doc_id AND a.page = b.page AND abs(a.y0 - b.y0) <= 0.11::DOUBLE GROUP BY 1, 2),
pages AS (SELECT p.*, coalesce(q.alignment_score, 0) AS alignment_score, {clamp(f"0.28::DOUBLE * number_score + 0.2::DOUBLE * org_score + 0.18::DOUBLE * regime_score + 0.18::DOUBLE * date_score + 0.12::DOUBLE * subject_score + {pts('number_score >= 0.65::DOUBLE AND date_score >= 0.55::DOUBLE', 0.08)} + {pts('org_score >= 0.55::DOUBLE AND regime_score >= 0.55::DOUBLE', 0.04)}")} AS header_score FROM pages0 p LEFT JOIN pairs q ON p.doc_id = q.doc_id AND p.page = q.page)
"""


PAGES = with_archive(", " + _sql().strip()).replace("\n, ", ",\n", 1)


def _columns(*names: str) -> str:
    return f"{PAGES}\nSELECT doc_id, page, {', '.join(f'round({n}, 6)::DOUBLE AS {n}' for n in names)} FROM pages"


def _scores(spark: SparkSession, sf_dir: str, *names: str) -> DataFrame:
    found = P.page_scores(planted(spark, sf_dir), BY)
    return found.select(*BY, *[F.round(n, 6).alias(n) for n in names])


@query(_columns("regime_score"))
def i20_regime(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir, "regime_score")


@query(_columns("org_score"))
def i21_issuing_organisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir, "org_score")


@query(_columns("alignment_score"))
def i22_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir, "alignment_score")


@query(_columns("reference_score"))
def i23_reference_penalty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir, "reference_score")


@query(_columns("header_score"))
def i24_header_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir, "header_score")


@query(_columns("subject_score"))
def i25_subject(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir, "subject_score")


@query(_columns("recipients_score"))
def i26_recipients(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir, "recipients_score")


@query(_columns("role_score"))
def i27_signer_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir, "role_score")


@query(_columns("name_score"))
def i28_signer_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir, "name_score")


@query(_columns("regime_score", "org_score", "number_score", "date_score", "subject_score", "alignment_score", "header_score", "reference_score"))
def i29_start_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All features of a page's chance to begin a document."""
    return _scores(spark, sf_dir, "regime_score", "org_score", "number_score", "date_score", "subject_score", "alignment_score", "header_score", "reference_score")


@query(_columns("recipients_score", "role_score", "name_score"))
def i30_signer_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir, "recipients_score", "role_score", "name_score")


@query(f"{PAGES}\nSELECT doc_id, page, ord, round(number_score, 6) AS score FROM nums")
def f08_number_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best three number lines of each page."""
    scored = P.line_scores(planted(spark, sf_dir), BY).where("number_score >= 0.45")
    return M.top_k(scored, BY, [F.col("number_score").desc(), F.col("ord")], 3).select(*BY, "ord", F.round("number_score", 6).alias("score"))


@query(f"{PAGES}\nSELECT doc_id, page, ord, round(date_score, 6) AS score FROM dates")
def f09_date_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = P.line_scores(planted(spark, sf_dir), BY).where("date_score >= 0.45")
    return M.top_k(scored, BY, [F.col("date_score").desc(), F.col("ord")], 3).select(*BY, "ord", F.round("date_score", 6).alias("score"))


@query(f"{PAGES}\nSELECT doc_id, count(*)::BIGINT AS n FROM (SELECT doc_id, page FROM pages WHERE page = 0 OR header_score >= 0.5) GROUP BY doc_id")
def e03_document_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that begin a document: the first, and those with enough of a header."""
    return P.page_scores(planted(spark, sf_dir), BY).where((F.col("page") == 0) | (F.col("header_score") >= 0.5)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"{PAGES}\nSELECT doc_id, min(ord) AS ord FROM folded WHERE starts_with(n, 'phu luc') GROUP BY doc_id")
def b19_appendix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first line that opens an appendix."""
    return planted(spark, sf_dir).where(F.startswith(T.squeeze(T.fold("text")), F.lit("phu luc"))).groupBy("doc_id").agg(F.min("ord").alias("ord"))
