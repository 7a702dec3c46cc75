"""Labelled fields of documents: checks and normal forms, votes of several labellers, words that a field stands for.

A document's fields, lines and words come as arrays of one row, so a document is checked where it is, in Arrow batches; votes
are aggregations over exploded fields.
"""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from .batches import per_row
from .greedy import iou

#: Labels; those set by rule or from metadata, which labellers' fields are dropped for; those of whole lines; those filled from whole lines.
LABELS = ("REGIME_HEADER", "ISSUE_ORG_SUPERIOR", "ISSUE_ORG_NAME", "DOC_NUMBER_SYMBOL", "PLACE_DATE", "DOC_SUBJECT", "ADDRESSEE", "RECIPIENTS", "SIGNER_ROLE", "SIGNER_NAME", "URGENCY_MARK", "SECRECY_MARK", "CIRCULATION_MARK", "DOC_TYPE")
BY_RULE = ("DOC_TYPE", "URGENCY_MARK", "SECRECY_MARK", "CIRCULATION_MARK")
BLOCKS = ("REGIME_HEADER", "ISSUE_ORG_SUPERIOR", "ISSUE_ORG_NAME", "DOC_NUMBER_SYMBOL", "DOC_SUBJECT", "ADDRESSEE", "RECIPIENTS", "SIGNER_ROLE")
FILLED = ("ISSUE_ORG_NAME", "SIGNER_NAME", "PLACE_DATE")
MARKS = ("URGENCY_MARK", "SECRECY_MARK", "CIRCULATION_MARK")
ANCHORS = {"ADDRESSEE": "kinh gui", "RECIPIENTS": "noi nhan"}
NO_SYMBOL = ("ngay ", "thang ", "nam ", "tai ", "kinh gui", "noi nhan")
SIGNED_BY, ROLE, NAME = "signed_by", "SIGNER_ROLE", "SIGNER_NAME"
#: Share of the smaller field's words from which two fields of different labels overlap.
OVERLAP = 0.5

FIELD = "struct<field_id:string,label:string,page_index:int,line_ids:array<string>,word_ids:array<string>,text:string,normalized_value:string,confidence:double>"
RELATION = "struct<relation_id:string,type:string,from_field_id:string,to_field_id:string,confidence:double>"
LINE = "struct<id:string,page_index:int,order:int,text:string,ocr_text:string,bbox:array<double>,word_ids:array<string>>"
WORD = "struct<id:string,line_id:string,page_index:int,order:int,text:string,has_space_after:boolean,bbox:array<double>>"


def folded(text: str | None) -> str:
    marks = unicodedata.normalize("NFD", (text or "").replace("đ", "d").replace("Đ", "D"))
    return " ".join("".join(c for c in marks if unicodedata.category(c) != "Mn").lower().split())


def normal_value(label: str, text: str | None) -> str | None:
    """White space squeezed; marks in capitals; none of a blank text."""
    raw = " ".join((text or "").split())
    return (raw.upper() if label in MARKS else raw) or None


class Rejected(ValueError):
    """Why a field or relation can't be taken."""


class Page:
    """A document's lines and words by id, in reading order."""

    def __init__(self, lines: list[dict] | None, words: list[dict] | None) -> None:
        self.lines, self.words = {x["id"]: x for x in lines or []}, {x["id"]: x for x in words or []}

    def ordered(self, ids: list[str], known: dict[str, dict]) -> list[str]:
        return sorted(dict.fromkeys(ids), key=lambda i: (known[i]["page_index"], known[i]["order"]))

    def line_text(self, i: str) -> str:
        line = self.lines[i]
        return (line["ocr_text"] or "").strip() or (line["text"] or "").strip()

    def words_of(self, lines: list[str]) -> list[str]:
        return [w for i in lines for w in self.lines[i]["word_ids"] or []]

    def text_of(self, words: list[str], lines: list[str]) -> str:
        joined = "".join((w["text"] or "") + (" " if w["has_space_after"] in (None, True) else "") for w in (self.words[i] for i in words)).strip()
        return joined or self.lines_text(lines)

    def lines_text(self, lines: list[str]) -> str:
        return "\n".join((self.lines[i]["text"] or "").strip() for i in lines).strip()


def _spanned(f: dict, page: Page) -> tuple[list[str], list[str]]:
    """The lines and words of a field, each filled from the other where its label allows that."""
    name, label = f["field_id"], f["label"]
    lines, words = list(f["line_ids"] or []), list(f["word_ids"] or [])
    for kind, ids, known in (("line_ids", lines, page.lines), ("word_ids", words, page.words)):
        if unknown := [i for i in ids if i not in known]:
            raise Rejected(f"unknown {kind} of {name}: {unknown}")
    if words and not lines and label != "DOC_NUMBER_SYMBOL":
        lines = [x for x in (page.words[w]["line_id"] for w in words) if x]
    elif lines and not words:
        whole = " ".join("\n".join(map(page.line_text, lines)).split())
        own = " ".join((f["text"] or "").split())
        if label not in BLOCKS and (label not in FILLED or own not in ("", whole)):
            raise Rejected(f"ambiguous lines without words of {name} ({label})")
        words = page.words_of(lines)
    lines, words = page.ordered(lines, page.lines), page.ordered(words, page.words)
    if not lines and not words:
        raise Rejected(f"neither line nor word in {name}")
    if label == "DOC_NUMBER_SYMBOL":
        _check_number(name, lines, page)
    if lines and (strange := [w for w in words if page.words[w]["line_id"] not in lines]):
        raise Rejected(f"words outside the lines of {name}: {strange}")
    return lines, words


def _check_number(name: str, lines: list[str], page: Page) -> None:
    """A number of several lines stands in neighbouring lines of one page, those after the first look like a symbol."""
    own = [page.lines[i] for i in lines]
    if len({x["page_index"] for x in own}) > 1:
        raise Rejected(f"number over several pages in {name}")
    orders = [x["order"] for x in own]
    if orders and orders != list(range(orders[0], orders[0] + len(orders))):
        raise Rejected(f"number in lines that aren't neighbours in {name}: {lines}")

    def place(x: dict) -> tuple:
        x0, y0, _, y1 = x["bbox"] or [0.0] * 4
        return y0 // max(12.0, 0.6 * max(1.0, y1 - y0)), x0

    for x in sorted(own, key=place)[1:]:
        text = (x["text"] or "").strip()
        if re.fullmatch(r"[*._~]+", text):
            continue
        if " ".join(text.lower().split()).startswith(NO_SYMBOL) or not re.fullmatch(r"[\w/\-().,:\s]+", text):
            raise Rejected(f"line that is no symbol in {name}: {text}")


def _confidence(what: str, value: float | None) -> None:
    if value is not None and not 0.0 <= value <= 1.0:
        raise Rejected(f"confidence out of range in {what}: {value}")


def _field(i: int, f: dict, page: Page) -> dict:
    lines, words = _spanned(f, page)
    pages = {page.lines[x]["page_index"] for x in lines} | {page.words[x]["page_index"] for x in words}
    if len(pages) > 1:
        raise Rejected(f"several pages in {f['field_id']}: {sorted(pages)}")
    (at,) = pages
    if f["page_index"] not in (None, at):
        raise Rejected(f"page {f['page_index']} instead of {at} in {f['field_id']}")
    block = f["label"] in BLOCKS and lines and not f["word_ids"]
    text = page.lines_text(lines) if block else (f["text"] or "").strip() or page.text_of(words, lines)
    if not text:
        raise Rejected(f"no text in {f['field_id']}")
    value = f["normalized_value"] if f["normalized_value"] is not None else normal_value(f["label"], text)
    _confidence(f["field_id"], f["confidence"])
    return {"field_id": f"f{i}", "label": f["label"], "page_index": at, "line_ids": lines, "word_ids": words, "text": text, "normalized_value": value, "confidence": f["confidence"]}


def checked(fields: list[dict] | None, relations: list[dict] | None, lines: list[dict] | None, words: list[dict] | None) -> tuple[list[str], list[str], list[dict], list[dict]]:
    """Errors, warnings, and the fields and relations in normal form, of a document's labels; with any error there are none.

    Fields set by rule are left out.  Warnings: an address or recipients whose lines have the usual word but whose text hasn't,
    and fields of different labels that share half of the smaller one's words.  A relation links a role with a name.
    """
    page = Page(lines, words)
    errors: list[str] = []
    warnings: list[str] = []
    taken: dict[str, dict] = {}
    seen: set[str] = set()
    for i, raw in enumerate(fields or [], 1):
        f = {**raw, "field_id": raw["field_id"] or f"f{i}", "label": (raw["label"] or "").strip().upper()}
        name = f["field_id"]
        try:
            if name in seen:
                raise Rejected(f"field_id used twice: {name}")
            seen.add(name)
            if f["label"] not in LABELS:
                raise Rejected(f"unknown label {f['label']} in {name}")
            if f["label"] in BY_RULE:
                continue
            made = _field(i, f, page)
        except Rejected as why:
            errors.append(str(why))
            continue
        anchor = ANCHORS.get(f["label"])
        if anchor and any(anchor in folded(page.line_text(x)) for x in made["line_ids"]) and anchor not in folded(made["text"]):
            warnings.append(f"anchor missing in {name} ({f['label']})")
        taken[name] = made
    out = list(taken.values())
    for k, a in enumerate(out):
        for b in out[k + 1 :]:
            common = set(a["word_ids"]) & set(b["word_ids"])
            if a["label"] != b["label"] and common and len(common) / min(len(a["word_ids"]), len(b["word_ids"])) >= OVERLAP:
                warnings.append(f"overlap of {a['field_id']} ({a['label']}) and {b['field_id']} ({b['label']})")
    links = []
    for i, r in enumerate(relations or [], 1):
        try:
            if (r["type"] or "").strip() != SIGNED_BY:
                raise Rejected(f"unknown relation {r['type']}")
            ends = [taken.get(r["from_field_id"]), taken.get(r["to_field_id"])]
            if None in ends:
                raise Rejected(f"relation {i} of unknown fields")
            if [e["label"] for e in ends] != [ROLE, NAME]:
                raise Rejected(f"relation {i} links {ends[0]['label']} with {ends[1]['label']}")
            _confidence(f"relation {i}", r["confidence"])
        except Rejected as why:
            errors.append(str(why))
            continue
        links.append({"relation_id": f"r{i}", "type": SIGNED_BY, "from_field_id": ends[0]["field_id"], "to_field_id": ends[1]["field_id"], "confidence": r["confidence"]})
    return (errors, warnings, [], []) if errors else (errors, warnings, out, links)


def validated(docs: DataFrame, fields: str = "fields", relations: str = "relations", lines: str = "lines", words: str = "words") -> DataFrame:
    """``docs`` with errors, warnings, valid_fields and valid_relations, as :func:`checked` gives them."""
    return per_row(docs, checked, f"errors array<string>, warnings array<string>, valid_fields array<{FIELD}>, valid_relations array<{RELATION}>", fields, relations, lines, words)


def vote_key(label: Column, page: Column, value: Column, text: Column) -> Column:
    """What makes two labellers' fields one: label, page and folded value, which is the squeezed text if none is given."""
    own = F.coalesce(F.nullif(value, F.lit("")), F.nullif(T.squeeze(F.coalesce(text, F.lit(""))), F.lit("")))
    return F.struct(F.upper(F.trim(F.coalesce(label, F.lit("")))).alias("label"), page.alias("page_index"), T.squeeze(T.fold(F.coalesce(own, F.lit("")))).alias("value"))


def consensus(fields: DataFrame, relations: DataFrame, least: int | None = None, key: str = "doc_id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Fields, relations and conflicts that labellers agree on.

    ``fields``: key, model, field_id, label, page_index, word_ids, line_ids, text, normalized_value, confidence; ``relations``: key,
    model, type, from_field_id, to_field_id.  A field needs ``least`` votes (two of several models, one of one); the best of its
    votes by confidence, words, lines and length of text, the first model of equals, stands for it.  Conflicts are (key,
    kind, what, votes).
    """
    models = fields.groupBy(key).agg(F.count_distinct("model").alias("models"))
    needed = F.lit(least) if least else F.when(F.col("models") >= 2, 2).otherwise(1)
    size = lambda c: F.size(F.coalesce(c, F.array().cast("array<string>")))
    rank = F.struct(F.coalesce("confidence", F.lit(0.0)).alias("c"), size("word_ids").alias("w"), size("line_ids").alias("l"), F.length(F.coalesce("text", F.lit(""))).alias("t"))
    voted = fields.withColumn("vote", vote_key(F.col("label"), F.col("page_index"), F.col("normalized_value"), F.col("text")))
    first = F.row_number().over(Window.partitionBy(key, "vote").orderBy(F.desc("rank"), "model", "field_id"))
    best = voted.withColumn("rank", rank).withColumn("r", first).where("r = 1").select(key, "vote", *[F.col(c) for c in fields.columns if c not in (key, "model", "field_id", "confidence")])
    votes = voted.groupBy(key, "vote").agg(F.array_sort(F.collect_list("model")).alias("supporting"), F.count(F.lit(1)).alias("votes")).join(models, key)
    kept = votes.where(F.col("votes") >= needed).withColumn("number", F.row_number().over(Window.partitionBy(key).orderBy("vote")))
    upper = F.when(F.upper(F.trim("label")).isin(*MARKS), F.upper(T.squeeze("text"))).otherwise(T.squeeze("text"))
    named = kept.join(best, [key, "vote"]).withColumn("field_id", F.concat(F.lit("f"), "number"))
    out = named.select(
        key, "field_id", "label", "page_index", "word_ids", "line_ids", "text", F.coalesce(F.nullif("normalized_value", F.lit("")), F.nullif(upper, F.lit(""))).alias("normalized_value"), F.round(F.col("votes") / F.col("models"), 4).alias("confidence"),
        F.when(F.col("votes") == F.col("models"), "auto_consensus").otherwise("needs_review").alias("review_status"), "supporting", "votes",
    )
    ids = voted.select(key, "model", "field_id", "vote")
    end = lambda side: ids.select(key, "model", F.col("field_id").alias(f"{side}_field_id"), F.col("vote").alias(side))
    linked = relations.join(end("from"), [key, "model", "from_field_id"]).join(end("to"), [key, "model", "to_field_id"])
    tallied = linked.groupBy(key, "type", "from", "to").agg(F.count(F.lit(1)).alias("votes")).join(models, key)
    new = named.select(key, "vote", "field_id")
    agreed = tallied.where(F.col("votes") >= needed).join(new.select(key, F.col("vote").alias("from"), F.col("field_id").alias("from_field_id")), [key, "from"]).join(new.select(key, F.col("vote").alias("to"), F.col("field_id").alias("to_field_id")), [key, "to"])
    turn = F.row_number().over(Window.partitionBy(key).orderBy("type", "from", "to"))
    links = agreed.select(key, F.concat(F.lit("r"), turn).alias("relation_id"), "type", "from_field_id", "to_field_id", F.round(F.col("votes") / F.col("models"), 4).alias("confidence"))
    lost = votes.where(F.col("votes") < needed).select(key, F.lit("field").alias("kind"), F.to_json("vote").alias("what"), "votes")
    lost = lost.unionByName(tallied.where(F.col("votes") < needed).select(key, F.lit("relation").alias("kind"), F.to_json(F.struct("type", "from", "to")).alias("what"), "votes"))
    return out, links, lost


def resolved_words(field: dict, words: list[dict], lines: list[dict], sizes: dict[int, tuple[float, float]]) -> tuple[list[str], str, float, int]:
    """The words that a field stands for, how they were found, the share of those it names, and its page; no words drop it.

    By its word ids; without any by its box, words three tenths in it or alike by a tenth, boxes beyond the page being of a
    thousand parts; without a box by its lines.
    """
    known = {w["id"]: w for w in words}
    named = [i for i in field["word_ids"] or [] if i]
    page = -1 if field["page_index"] is None else field["page_index"]
    box, source = field["bbox"], "word_ids"
    if named:
        found = [i for i in dict.fromkeys(named) if i in known]
    elif box and page in sizes:
        source, (width, height) = "bbox_overlap", sizes[page]
        if max(box) > 1.2 * max(width, height):
            box = [x / 1000 * side for x, side in zip(box, (width, height, width, height), strict=True)]

        def inside(b: list[float]) -> bool:
            w, h = min(b[2], box[2]) - max(b[0], box[0]), min(b[3], box[3]) - max(b[1], box[1])
            area = max(0.0, b[2] - b[0]) * max(0.0, b[3] - b[1])
            return (w > 0 and h > 0 and area > 0 and w * h / area >= 0.3) or iou(tuple(b), tuple(box)) >= 0.1

        found = [w["id"] for w in words if w["page_index"] == page and inside(w["bbox"])]
    else:
        source, own = "line_ids_fallback", {x["id"]: x["word_ids"] or [] for x in lines}
        found = [w for w in dict.fromkeys(w for i in field["line_ids"] or [] for w in own.get(i, [])) if w in known]
    expected = len(named) if named else len(found)
    return found, source, len(found) / max(1, expected), page if page >= 0 or not found else known[found[0]]["page_index"]


def resolved(docs: DataFrame, fields: str, words: str, lines: str, pages: str) -> DataFrame:
    """(docs' columns, resolved): of each field with a known label and any word its words, source, coverage, page and box.

    ``pages``: array of struct (page_index, width, height).
    """

    def of(own: list[dict] | None, w: list[dict] | None, x: list[dict] | None, p: list[dict] | None) -> tuple:
        known, sizes, out = {v["id"]: v for v in w or []}, {v["page_index"]: (v["width"], v["height"]) for v in p or []}, []
        for f in own or []:
            if f["label"] not in LABELS:
                continue
            ids, source, share, page = resolved_words(f, w or [], x or [], sizes)
            if ids:
                boxes = [known[i]["bbox"] for i in ids]
                out.append({"field_id": f["field_id"], "label": f["label"], "page_index": page, "word_ids": ids, "bbox": [side(b[k] for b in boxes) for k, side in enumerate((min, min, max, max))], "coverage": share, "source": source})
        return (out,)

    schema = "resolved array<struct<field_id:string,label:string,page_index:int,word_ids:array<string>,bbox:array<double>,coverage:double,source:string>>"
    return per_row(docs, of, schema, fields, words, lines, pages)
