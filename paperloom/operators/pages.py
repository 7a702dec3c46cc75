"""Page scores by rule: a score for each line from its text and place, and each page's best.

Lines are rows (page columns, ord, text, x0, y0, x1) with coordinates from 0 to 1.  All scores of a page come from one
aggregation over its lines; the role a few lines above a name, and pairs of number and date lines, by windows of the page.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geometry as G
from ..functions import text as T

#: Keywords in folded text.
ORG_KEYWORDS = ("dang uy", "ban chap hanh", "ban thuong vu", "uy ban", "ubnd", "hdnd", "hoi dong", "mat tran", "bo ", "so ", "phong", "ban ", "cong an", "vien kiem sat", "toa an", "doan ", "hoi ", "truong", "cuc ", "huyen uy", "tinh uy")
SUBJECT_KEYWORDS = ("ve viec", "quyet dinh", "ke hoach", "bao cao", "thong bao", "to trinh", "cong van", "chuong trinh", "huong dan", "quy che", "nghi quyet", "de an", "ket luan", "bien ban", "phuong an")
ROLE_KEYWORDS = ("chu tich", "pho chu tich", "bi thu", "pho bi thu", "giam doc", "pho giam doc", "tong giam doc", "chanh van phong", "pho chanh", "truong ban", "pho truong", "truong phong", "pho phong", "thu truong", "bo truong", "cuc truong", "nguoi ky")
SURNAMES = ("nguyen", "tran", "le", "pham", "hoang", "huynh", "phan", "vu", "vo", "dang", "bui", "do", "ho", "ngo", "duong", "ly", "trinh", "dinh", "mai", "cao", "dao", "luu", "truong")
#: Fixed patterns in folded text.
NUMBER = r"\bso\s*[:.]?\s*[0-9]"
SYMBOL = r"\b[0-9]{1,5}\s*([/.-]\s*[a-z0-9]+)+"
NUMBER_FIRST = r"^[^0-9a-z_]*so\s*[:.]?\s*[0-9]"
SO_FIRST = r"^[^0-9a-z_]*so\b"
DATE = r"\bngay\s+[0-9]{1,2}\s+thang\s+[0-9]{1,2}\s+nam\s+[0-9]{4}\b"
RECIPIENTS = r"\bnoi\s*nhan\b"
SIGNER = r"\b(t/?m|k/?t|t/?l|tuq|q\.)\b"
#: Lines above a name among which its role may stand.
ROLE_WITHIN = 5


def _any(c: Column, keywords: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(c, F.lit(k)) for k in keywords])


def _points(condition: Column, points: float) -> Column:
    return F.when(condition, F.lit(points)).otherwise(F.lit(0.0))


def line_scores(lines: DataFrame, by: list[str]) -> DataFrame:
    """``lines`` with folded text and the scores of each line."""
    n, x0, y0, x1 = F.col("n"), F.col("x0"), F.col("y0"), F.col("x1")
    base = lines.withColumn("n", T.squeeze(T.fold("text"))).withColumn("cx", (x0 + x1) / 2).withColumn("upper", T.uppercase_ratio("text")).withColumn("width", F.greatest(F.lit(0.0), x1 - x0))
    cx, upper, width = F.col("cx"), F.col("upper"), F.col("width")
    words = sum((n.rlike(rf"\b{k}\b").cast("int") for k in ("ngay", "thang", "nam")), F.lit(0))
    hits = sum((F.contains(n, F.lit(k)).cast("int") for k in ORG_KEYWORDS), F.lit(0))
    penalty = _points(n.startswith("(") | n.endswith(")"), 0.35) + _points(F.length(n) > 70, 0.25) + _points(x1 - x0 > 0.62, 0.20)
    flagged = base.withColumns({
        "regime": F.contains(n, F.lit("cong hoa xa hoi chu nghia")) | F.contains(n, F.lit("dang cong san viet nam")),
        "motto": F.contains(n, F.lit("doc lap")) & F.contains(n, F.lit("tu do")) & F.contains(n, F.lit("hanh phuc")),
        "role": n.rlike(SIGNER) | _any(n, ROLE_KEYWORDS), "penalty": penalty, "org_hits": hits, "date_words": words,
        "numbered": n.rlike(NUMBER) | n.rlike(SYMBOL), "number_first": n.rlike(NUMBER_FIRST), "dated": n.rlike(DATE),
    })
    org = F.when((y0 <= 0.38) & (F.col("org_hits") > 0), G.clamp01(0.35 + F.least(F.lit(0.30), F.col("org_hits") * 0.12) + _points(cx < 0.45, 0.20) + _points(y0 < 0.22, 0.10) + _points(upper >= 0.55, 0.10))).otherwise(F.lit(0.0))
    number = F.when((y0 <= 0.48) & (F.col("numbered") | n.rlike(SO_FIRST)), G.clamp01(
        F.when(F.col("number_first"), 0.62).when(n.rlike(SO_FIRST), 0.35).otherwise(0.12) + _points(n.rlike(SYMBOL), 0.22) + _points(x0 < 0.34, 0.10) + _points(cx < 0.52, 0.08)
        + F.when(width <= 0.42, 0.10).when(width <= 0.56, 0.04).otherwise(0.0) + _points(y0.between(0.12, 0.44), 0.06) - F.col("penalty")))
    date = F.when((y0 <= 0.50) & (F.col("date_words") >= 2), G.clamp01(
        F.when(F.col("dated"), 0.72).when((F.col("date_words") >= 3) & n.rlike(r"\b[0-9]{4}\b"), 0.55).otherwise(0.32) + _points(cx > 0.45, 0.12) + _points(x0 > 0.32, 0.08)
        + _points(width <= 0.55, 0.08) + _points(y0.between(0.16, 0.48), 0.05) - F.col("penalty")))
    about = F.when(F.contains(n, F.lit("ve viec")), 1.0).when(_any(n, SUBJECT_KEYWORDS), 0.75)
    subject = F.when(y0.between(0.16, 0.68) & about.isNotNull(), G.clamp01(about + _points(upper >= 0.55, 0.10))).otherwise(F.lit(0.0))
    recipients = F.when(n.rlike(RECIPIENTS), F.when(y0 > 0.55, 1.0).when(y0 > 0.35, 0.90).otherwise(0.70)).otherwise(F.lit(0.0))
    role = F.when((y0 >= 0.30) & F.col("role"), G.clamp01(_points(n.rlike(SIGNER), 0.55) + _points(_any(n, ROLE_KEYWORDS), 0.35) + _points(y0 > 0.45, 0.08) + _points(cx > 0.40, 0.05))).otherwise(F.lit(0.0))
    bent = F.when(F.col("penalty") > 0, F.least(F.lit(1.0), 0.45 + F.col("penalty"))).otherwise(F.lit(0.0))
    reference = F.when((y0 <= 0.56) & (F.col("numbered") | F.col("dated")) & ~F.col("number_first"), F.greatest(bent, _points(F.length(n) > 85, 0.65))).otherwise(F.lit(0.0))
    above = F.max("role").over(Window.partitionBy(*by).orderBy("ord").rowsBetween(-ROLE_WITHIN, -1))
    tokens = F.filter(F.split(F.trim("text"), r"\s+"), lambda t: t != "")
    plain = F.transform(tokens, lambda t: T.fold(t))
    capitals = F.size(F.filter(tokens, lambda t: F.left(t, F.lit(1)).rlike(r"\p{Lu}")))
    size = F.size(tokens)
    nameable = (y0 >= 0.34) & ~n.rlike("[0-9]") & ~n.rlike(RECIPIENTS) & ~F.col("role") & size.between(2, 5) & ~F.exists(plain, lambda t: F.length(t) <= 1)
    name = F.when(nameable, G.clamp01(
        F.when(upper >= 0.55, 0.40).when(capitals >= F.greatest(F.lit(2), size - 1), 0.28).otherwise(0.0) + _points(F.element_at(plain, 1).isin(*SURNAMES), 0.30)
        + _points(F.coalesce(above, F.lit(False)), 0.25) + _points(y0 > 0.45, 0.05) + _points(cx > 0.35, 0.05))).otherwise(F.lit(0.0))
    return flagged.withColumns({"org_score": org, "number_score": number, "date_score": date, "subject_score": subject, "recipients_score": recipients, "role_score": role, "reference_score": reference, "name_score": name})


def alignment(scored: DataFrame, by: list[str]) -> DataFrame:
    """(by, alignment_score): the best pair of the three best number lines and the three best date lines of a page."""

    def best(score: str, name: str) -> DataFrame:
        able = scored.where(F.col(score) >= 0.45)
        r = F.row_number().over(Window.partitionBy(*by).orderBy(F.col(score).desc(), "ord"))
        return able.withColumn("r", r).where("r <= 3").select(*by, F.struct(F.col(score).alias("s"), "x0", "y0").alias(name))

    pairs = best("number_score", "a").join(best("date_score", "b"), by)
    gap = F.abs(F.col("a.y0") - F.col("b.y0"))
    score = G.clamp01(0.55 + _points((F.col("a.x0") < 0.38) & (F.col("b.x0") > 0.30), 0.25) + _points(gap <= 0.045, 0.15) + 0.05 * F.least("a.s", "b.s"))
    return pairs.where(gap <= 0.11).groupBy(*by).agg(F.max(score).alias("alignment_score"))


def page_scores(lines: DataFrame, by: list[str]) -> DataFrame:
    """A row for each page with all its scores."""
    scored = line_scores(lines, by)
    top, right = F.col("y0") < 0.34, F.col("cx") > 0.42
    regime, motto = F.max(top & F.col("regime")), F.max(top & F.col("motto"))
    marked = F.max(top & right & (F.col("regime") | F.col("motto")))
    best = [F.coalesce(F.max(s), F.lit(0.0)).alias(s) for s in ("org_score", "number_score", "date_score", "subject_score", "recipients_score", "role_score", "reference_score", "name_score")]
    pages = scored.groupBy(*by).agg(G.clamp01(_points(regime, 0.70) + _points(motto, 0.30) + _points(marked, 0.10)).alias("regime_score"), *best, F.max(F.col("n").rlike(RECIPIENTS)).alias("has_recipients"), F.max(F.col("n").rlike(SIGNER)).alias("has_signer_prefix"))
    doc, org, regime_score, date, subject = map(F.col, ("number_score", "org_score", "regime_score", "date_score", "subject_score"))
    header = G.clamp01(0.28 * doc + 0.20 * org + 0.18 * regime_score + 0.18 * date + 0.12 * subject + _points((doc >= 0.65) & (date >= 0.55), 0.08) + _points((org >= 0.55) & (regime_score >= 0.55), 0.04))
    return pages.join(alignment(scored, by), by, "left").withColumn("header_score", header).withColumn("alignment_score", F.coalesce("alignment_score", F.lit(0.0)))
