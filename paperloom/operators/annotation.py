"""Annotations of scanned documents: which pages to read, which fields to keep, scores and repairs of field instances."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from .batches import per_row

#: Words of a signature, of recipients and of roles, with their points.
PAGE_KEYWORDS = (
    (5, ("k/t", "t/m", "t/l", "tl.", "tm.", "kt.", "tuq.")),
    (3, ("noi nhan", "kinh gui")),
    (2, ("chanh van phong", "chu tich", "pho chu tich", "bi thu", "pho bi thu", "thu truong", "bo truong", "giam doc", "pho giam doc", "tong giam doc", "truong ban", "pho truong ban", "truong phong", "pho truong phong", "chu tri", "thu ky", "nguoi ky")),
)
#: Words that speak for a label, labels of the first page, labels that other pages may have.
ANCHORS = {
    "REGIME_HEADER": ("dang cong san", "cong hoa", "doc lap", "tu do", "hanh phuc"), "DOC_NUMBER_SYMBOL": ("so ", "so:", "so."), "PLACE_DATE": ("ngay", "thang", "nam", "ha noi", "tp. ho chi minh", "ho chi minh"),
    "DOC_SUBJECT": ("ve ", "ke hoach", "thong bao", "nghi dinh", "quyet dinh", "to trinh", "bao cao", "cong van", "giay moi", "chuong trinh"), "ADDRESSEE": ("kinh gui",), "RECIPIENTS": ("noi nhan",),
    "SIGNER_ROLE": ("t/m", "tm.", "kt.", "chu tich", "bi thu", "chanh van phong", "truong ban"),
}
FIRST_PAGE = ("REGIME_HEADER", "ISSUE_ORG_SUPERIOR", "ISSUE_ORG_NAME", "DOC_NUMBER_SYMBOL", "PLACE_DATE", "DOC_SUBJECT", "ADDRESSEE")
OTHER_PAGES = ("RECIPIENTS", "SIGNER_ROLE", "SIGNER_NAME")
#: Fixed patterns in folded text.
DOC_NUMBER = r"\bso\s*[:.]?\s*[0-9]"
DATE = r"\b(?:ngay\s*[0-9]{1,2}\s*thang\s*[0-9]{1,2}|tp\.?\s*ho\s+chi\s+minh|ha\s+noi)"
#: F1 and recall from which a candidate is right, and the F1 up to which it is wrong, by field.
MATCHES = {
    "REGIME_HEADER": (0.88, 0.85, 0.20), "ISSUE_ORG_SUPERIOR": (0.88, 0.85, 0.20), "ISSUE_ORG_NAME": (0.88, 0.85, 0.20), "DOC_NUMBER_SYMBOL": (0.92, 0.90, 0.20), "PLACE_DATE": (0.92, 0.90, 0.20), "DOC_SUBJECT": (0.88, 0.85, 0.20),
    "ADDRESSEE": (0.85, 0.80, 0.20), "RECIPIENTS": (0.85, 0.80, 0.20), "SIGNER_ROLE": (0.86, 0.82, 0.20), "SIGNER_NAME": (0.92, 0.90, 0.20),
}
#: Fields of several lines, of several instances, the gaps that are bridged, the score of a gap's words at most.
BLOCKS, SEVERAL, GAPS, SURE = ("DOC_SUBJECT", "RECIPIENTS", "ADDRESSEE"), ("SIGNER_ROLE", "SIGNER_NAME"), {"DOC_SUBJECT": 1, "RECIPIENTS": 2, "ADDRESSEE": 1}, 0.72
#: Kinds of regions that an auxiliary analysis may add.
AUXILIARY = ("Footnote", "Page-header", "Page-footer")
#: Parts of a token: letters and digits joined by slashes, a dash, any other mark.
TOKEN = re.compile(r"[A-Za-zÀ-ỹĐđ0-9]+(?:/[A-Za-zÀ-ỹĐđ0-9]+)*|[-–—]|[^\w\s]")


def page_candidates(pages: DataFrame, key: str = "doc_id") -> DataFrame:
    """``pages`` (key, page, first_line, text) with score, appendix and pages: the points of the words that a signature page has.

    The last two of more than two pages gain a point if they have any; an appendix loses four.
    """
    found = T.squeeze(T.fold("text"))
    points = sum((F.when(F.contains(F.col("n__"), F.lit(w)), p).otherwise(0) for p, words in PAGE_KEYWORDS for w in words), F.lit(0))
    total = F.count(F.lit(1)).over(Window.partitionBy(key))
    rows = pages.withColumn("n__", found).withColumn("pages", total).withColumn("appendix", F.contains(T.squeeze(T.fold(F.coalesce("first_line", F.lit("")))), F.lit("phu luc"))).withColumn("score", points)
    late = F.when((F.col("score") > 0) & (F.col("pages") > 2) & (F.col("page") >= F.col("pages") - 2), 1).otherwise(0)
    return rows.withColumn("score", (F.col("score") + late - F.when(F.col("appendix"), 4).otherwise(0)).cast("int")).drop("n__")


def page_selection(pages: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, selected, primary, signature, strategy, confidence, needs_review): the pages of a document worth reading.

    All of three pages or fewer; else the first, the last that is no appendix, and of the others without appendix that of
    the highest score, the last of equals, if it has any.
    """
    rows = page_candidates(pages, key)
    first, n = F.min("page"), F.max("pages")
    last = F.coalesce(F.max(F.when(~F.col("appendix"), F.col("page"))), F.max("page"))
    best = F.max(F.when((F.col("score") > 0) & ~F.col("appendix") & (F.col("page") > F.col("first")), F.struct("score", "page")))
    whole = rows.withColumn("first", F.min("page").over(Window.partitionBy(key))).groupBy(key).agg(first.alias("primary"), n.alias("n"), last.alias("last"), best.alias("best"), F.array_sort(F.collect_list("page")).alias("every"))
    p, z, b = F.col("primary"), F.col("last"), F.col("best")
    few = F.col("n") <= 3
    chosen = F.when(few, F.col("every")).when(b.isNotNull(), F.array_sort(F.array_distinct(F.array(p, z, b.page)))).otherwise(F.array_sort(F.array_distinct(F.array(p, z))))
    signature = F.when(F.col("n") == 1, None).when(~few & b.isNotNull(), b.page).when(z != p, z)
    strategy = F.when(F.col("n") == 1, "single_page_document").when(few, "all_pages_small_document").when(b.isNotNull(), "first_last_plus_keyword_match").otherwise("first_last_non_appendix")
    sure = few | (b.score >= 5)
    return whole.select(key, chosen.alias("selected"), "primary", signature.alias("signature"), strategy.alias("strategy"), F.when(F.coalesce(sure, F.lit(False)), "high").otherwise("medium").alias("confidence"), (~few & F.coalesce(b.score < 5, F.lit(False))).alias("needs_review"))


def signer_match(name: Column, text: Column) -> Column:
    """exact if the folded name stands in the text, partial if its last two words or a last word of over two letters do."""
    n, t = T.squeeze(T.fold(name)), T.squeeze(T.fold(text))
    parts = F.split(n, " ")
    two, one = F.array_join(F.slice(parts, -2, 2), " "), F.element_at(parts, -1)
    partial = ((F.size(parts) >= 2) & F.contains(t, two)) | ((F.length(one) > 2) & F.contains(t, one))
    return F.when(n == "", None).when(F.contains(t, n), "exact").when(partial, "partial")


def boosted_selection(selection: DataFrame, signers: DataFrame, pages: DataFrame, key: str = "doc_id") -> DataFrame:
    """``selection`` one step surer and without review where the signer's name (key, signer) stands on the signature page; ``match`` says how.

    What is sure already, needs no review, or has no signature page or name is left as it is.
    """
    texts = pages.select(F.col(key), F.col("page").alias("signature"), F.col("text").alias("text__"))
    rows = selection.join(signers, key, "left").join(texts, [key, "signature"], "left")
    asks = F.col("needs_review") & (F.col("confidence") != "high") & (F.coalesce("signer", F.lit("")) != "")
    rows = rows.withColumn("match", F.when(asks, signer_match(F.col("signer"), F.col("text__"))))
    hit = F.col("match").isNotNull()
    surer = F.when(hit & (F.col("confidence") == "medium"), "high").when(hit & (F.col("confidence") == "low"), "medium").otherwise(F.col("confidence"))
    return rows.select(*[c for c in selection.columns if c not in ("confidence", "needs_review")], surer.alias("confidence"), (F.col("needs_review") & ~hit).alias("needs_review"), "match")


def primary_page_fields(instances: DataFrame, key: str = "doc_id") -> DataFrame:
    """``instances`` (key, page, label) where a document's other pages keep recipients and signers only, if it has the first page too."""
    first = F.max(F.col("page") == 0).over(Window.partitionBy(key))
    return instances.withColumn("first__", first).where(~F.col("first__") | (F.col("page") == 0) | F.col("label").isin(*OTHER_PAGES)).drop("first__")


def instance_score(label: Column, text: Column, words: Column, lines: Column, confidence: Column, page: Column, pages: Column, box: Column) -> Column:
    """How well an instance fits its label: its size, confidence, words, place and form.  ``words`` null: the text's own."""
    n = T.squeeze(T.fold(F.coalesce(text, F.lit(""))))
    own = F.coalesce(F.nullif(words, F.lit(0)), F.when(n == "", 0).otherwise(F.size(F.split(n, " "))))
    when = lambda c, x: F.when(c, F.lit(x)).otherwise(F.lit(0.0))
    anchored = reduce(lambda a, b: a | b, [(label == k) & reduce(lambda a, b: a | b, [F.contains(n, F.lit(w)) for w in words_]) for k, words_ in ANCHORS.items()])
    numbered, dated = n.rlike(DOC_NUMBER), n.rlike(DATE)
    score = F.least(F.lit(2.5), own * 0.08) + F.least(F.lit(1.0), F.greatest(F.lit(1), F.coalesce(lines, F.lit(0))) * 0.15) + F.least(F.lit(2.0), F.greatest(F.lit(-2.0), F.coalesce(confidence, F.lit(0.0))))
    score = score + when(anchored, 1.2) + F.when(label.isin(*FIRST_PAGE), F.greatest(F.lit(0.0), 1.0 - page * 0.35)).otherwise(F.lit(0.0)) + F.when(label == "RECIPIENTS", F.least(F.lit(1.2), page * 0.15)).otherwise(F.lit(0.0))
    subject = label == "DOC_SUBJECT"
    score = score - when(subject & (F.length(n) < 10), 2.5) - when(subject & (numbered | dated), 1.5) - when((label == "DOC_NUMBER_SYMBOL") & ~numbered, 1.0) - when((label == "PLACE_DATE") & ~dated, 1.0)
    return score - when((label == "RECIPIENTS") & ~F.contains(n, F.lit("noi nhan")), 0.7) - when((pages > 0) & (page >= pages), 2.0) - when((box[2] <= box[0]) | (box[3] <= box[1]), 1.0)


def candidate_match(field: Column, words: Column, gold: Column) -> Column:
    """struct (target, field_id, overlap, precision, recall, f1): the gold instance (field_id, word_ids) that a candidate fits best, the first of equals.

    The target is 1 from the field's F1 and recall on, 0 up to the F1 of chance, null between.
    """
    own = F.array_distinct(words)

    def measure(g: Column) -> Column:
        theirs = F.array_distinct(g.word_ids)
        common = F.size(F.array_intersect(own, theirs))
        p, r = common / F.greatest(F.size(own), F.lit(1)), common / F.greatest(F.size(theirs), F.lit(1))
        f1 = 2.0 * p * r / F.greatest(p + r, F.lit(1e-9))
        return F.struct(g.field_id.alias("field_id"), common.alias("overlap"), p.alias("precision"), r.alias("recall"), f1.alias("f1"))

    none = F.struct(F.lit(None).cast("string").alias("field_id"), F.lit(0).alias("overlap"), F.lit(0.0).alias("precision"), F.lit(0.0).alias("recall"), F.lit(0.0).alias("f1"))
    best = F.aggregate(F.transform(gold, measure), none, lambda a, x: F.when(x.f1 > a.f1, x).otherwise(a))
    limit = lambda i: F.create_map(*[F.lit(x) for k, v in MATCHES.items() for x in (k, v[i])])[field]
    target = F.when((best.f1 >= limit(0)) & (best.recall >= limit(1)), 1).when(best.f1 > limit(2), None).otherwise(0)
    return F.struct(target.alias("target"), best.field_id.alias("field_id"), best.overlap.alias("overlap"), best.precision.alias("precision"), best.recall.alias("recall"), best.f1.alias("f1"))


def _close(a: list[float], b: list[float], block: bool) -> bool:
    """Whether the second word follows the first in one line, or in a block close below it."""
    middle = lambda x: (x[1] + x[3]) / 2
    high = max(1.0, a[3] - a[1], b[3] - b[1])
    if abs(middle(a) - middle(b)) <= max(10.0, 0.85 * high):
        return True
    if not block or middle(b) < middle(a) or b[1] - a[3] > max(42.0, 2.1 * high):
        return False
    shared = max(0.0, min(a[2], b[2]) - max(a[0], b[0])) / max(1.0, min(a[2] - a[0], b[2] - b[0]))
    return shared >= 0.10 or b[0] <= a[0] + 220.0


def repaired_tags(tags: list[str], boxes: list[list[float]], scores: list[float] | None) -> tuple[list[str], int, int]:
    """Tags with restarts of one field made continuations, and short unsure gaps bridged, where the words are close; and how many of each."""
    out, joined, bridged = list(tags), 0, 0
    field = lambda t: t[2:] if t[:2] in ("B-", "I-") else "O"
    close = lambda i, j, f: j < len(boxes) and _close(boxes[i], boxes[j], f in BLOCKS)
    for i in range(1, len(out)):
        f = field(out[i])
        if out[i].startswith("B-") and f not in SEVERAL and field(out[i - 1]) == f and close(i - 1, i, f):
            out[i] = f"I-{f}"
            joined += 1
    taken = [i for i, t in enumerate(out) if field(t) != "O"]
    for a, b in zip(taken, taken[1:], strict=False):
        f, gap = field(out[a]), range(a + 1, b)
        if not gap or field(out[b]) != f or len(gap) > GAPS.get(f, 1) or not scores:
            continue
        if max((scores[i] for i in gap if i < len(scores)), default=0.0) <= SURE and close(a, b, f):
            out[a + 1 : b] = [f"I-{f}"] * len(gap)
            bridged += 1
    return out, joined, bridged


def repaired_rows(rows: DataFrame, tags: str, boxes: str, scores: str) -> DataFrame:
    return per_row(rows, lambda t, b, s: repaired_tags(t or [], b or [], s), "repaired array<string>, joined int, bridged int", tags, boxes, scores)


def token_parts(text: str, box: list[float], start: int) -> list[dict]:
    """A token cut into its parts, each with its share of the box by characters; a token of one part stays whole."""
    found = list(TOKEN.finditer(text))
    if len(found) <= 1:
        return [{"text": text, "box": box, "start": start, "end": start + len(text)}]
    x0, y0, x1, y1 = box
    at = lambda i: round(x0 + (x1 - x0) * i / max(1, len(text)), 2)
    return [{"text": m.group(), "box": [at(m.start()), round(y0, 2), at(m.end()), round(y1, 2)], "start": start + m.start(), "end": start + m.end()} for m in found]


def split_tokens(rows: DataFrame, text: str, box: str, start: str) -> DataFrame:
    return per_row(rows, lambda t, b, s: (token_parts(t or "", b, s),), "parts array<struct<text:string,box:array<double>,start:bigint,`end`:bigint>>", text, box, start)


def merged_regions(primary: list[dict] | None, auxiliary: list[dict] | None) -> list[dict]:
    """Regions (id, type, bbox, source) of an analysis, and footnotes, headers and footers of another that it hasn't to a tenth."""
    out = list(primary or [])
    name = lambda r: (r["type"] or "", tuple(round(float(x), 1) for x in r["bbox"][:4]))
    known = {name(r) for r in out if r["bbox"]}
    for r in auxiliary or []:
        if r["type"] in AUXILIARY and len(r["bbox"] or []) >= 4 and name(r) not in known:
            known.add(name(r))
            out.append({**r, "source": r["source"] or "doclaynet", "id": f"doclaynet_{len(out) if r['id'] is None else r['id']}"})
    return out


def with_auxiliary(pages: DataFrame, primary: str, auxiliary: str) -> DataFrame:
    kind = "array<struct<id:string,type:string,bbox:array<double>,source:string>>"
    return per_row(pages, lambda a, b: (merged_regions(a, b),), f"regions {kind}", primary, auxiliary)


def word_labels(pieces: DataFrame, words: DataFrame, by: list[str], logits: str, labels: list[str]) -> DataFrame:
    """(by, label, score) of ``words``: the label with the highest mean probability over a word's pieces; O and 0 without any.

    ``pieces``: by, ``logits`` (array, a number for each label).  Sums of probabilities are added up by label, before any shuffle.
    """
    top = F.array_max(logits)
    powers = F.transform(logits, lambda x: F.exp(x - F.col("top__")))
    total = F.aggregate("p__", F.lit(0.0), lambda a, x: a + x)
    rows = pieces.withColumn("top__", top).withColumn("p__", powers).withColumn("sum__", total)
    mean = [F.avg(F.get("p__", F.lit(i)) / F.col("sum__")).alias(f"m{i}") for i in range(len(labels))]
    found = rows.groupBy(*by).agg(*mean)
    best = F.array_max(F.array(*[F.struct(F.col(f"m{i}").alias("p"), F.lit(-i).alias("i"), F.lit(name).alias("label")) for i, name in enumerate(labels)]))
    named = found.select(*by, best.alias("b"))
    return words.select(*by).join(named, by, "left").select(*by, F.coalesce("b.label", F.lit("O")).alias("label"), F.coalesce("b.p", F.lit(0.0)).alias("score"))


def is_page_number_text(text: Column) -> Column:
    """Under five characters of digits and marks, a digit among them."""
    t = T.squeeze_ends(text)
    return (F.length(t) < 5) & t.rlike(r"^[0-9!@#$%^&*():;,.\-]+$") & t.rlike("[0-9]")


def page_numbers(lines: DataFrame, page: list[str], order: str = "y") -> DataFrame:
    """``lines`` with ``is_page_number``: such texts of under three characters anywhere, others as a page's first or last line."""
    up, down = Window.partitionBy(*page).orderBy(order, "ord"), Window.partitionBy(*page).orderBy(F.desc(order), F.desc("ord"))
    edge = (F.row_number().over(up) == 1) | (F.row_number().over(down) == 1)
    return lines.withColumn("is_page_number", is_page_number_text(F.col("text")) & ((F.length(T.squeeze_ends("text")) < 3) | edge))


def numbered_bullet(text: Column) -> Column:
    """Whether a text begins with 1. or 1.2., a Roman number and a dot, a letter or number and a bracket, or either in brackets.

    Four digits and a dot alone are a year; a number such as 18.000 is none, since a bullet ends the text or a space follows.
    """
    t = T.squeeze_ends(text)
    letter = r"\p{L}"
    return ~t.rlike(r"^[0-9]{4}\.$") & t.rlike(rf"(?U)^(?:(?:[0-9]+(?:\.[0-9]+)*\.|[IVX]+\.|{letter}\)|[0-9]+\))(?:\s|$)|\((?:[0-9]+|{letter})\)\s)")


def metadata_overrides(fields: dict[str, Column], form: dict[str, Column], date: Column) -> dict[str, Column]:
    """Stored fields with what the final form has in their place, squeezed; blank entries change nothing.

    Number and symbol are joined by a dash; an issuer in the form blanks the superior issuer.  ``date`` is the form's date as shown.
    """
    own = lambda name: F.nullif(T.squeeze(form[name]), F.lit(""))
    number = F.nullif(F.concat_ws("-", own("number"), own("symbol")), F.lit(""))
    new = {"subject": own("subject"), "number_symbol": number, "place_date": F.nullif(date, F.lit("")), "issuer": own("issuer"), "type": own("type"), "signer": own("signer"), "secrecy": own("secrecy")}
    out = {k: F.coalesce(new[k], c) if k in new else c for k, c in fields.items()}
    return out | {"superior": F.when(own("issuer").isNotNull(), F.lit("")).otherwise(fields["superior"])}


def fields_of_form(form: dict[str, Column], iso_date: Column) -> dict[str, Column]:
    """The stored fields that a sheet's columns give: trimmed, number and symbol written as one; others are blank."""
    own = lambda name: F.trim(F.coalesce(form[name], F.lit("")))
    number, symbol = own("number"), own("symbol")
    joined = F.when((number != "") & (symbol != ""), F.concat(F.lit("Số: "), number, F.lit("/"), symbol)).when(number != "", F.concat(F.lit("Số: "), number)).otherwise(symbol)
    direct = {"issuer": "issuer", "subject": "subject", "signer": "signer", "type": "type", "secrecy": "confidentiality", "circulation": "access"}
    return {k: own(v) for k, v in direct.items()} | {"number_symbol": joined, "place_date": F.coalesce(iso_date, F.lit("")), "superior": F.lit(""), "addressee": F.lit("")}
