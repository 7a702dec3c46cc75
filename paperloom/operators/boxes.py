"""Boxes on a page: near-equal boxes, boxes of matched words, regions of lines, windows of words, visual lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fuzzy
from ..functions import text as T
from .batches import per_row

#: Which kind of region wins a near tie.
PRIORITY = (("footnote", 100), ("table_footnote", 95), ("page-footer", 90), ("page-header", 85), ("table", 80), ("title", 70), ("section-header", 68), ("caption", 65), ("table_caption", 65), ("figure_caption", 65))
NEAR_TIE, LEAST_OVERLAP = 0.03, 0.3
#: Words in the longest window of a field's candidates.
MOST_WORDS = 12

BOX = "array<double>"


def union(boxes: Column) -> Column:
    """The least box around all of an array of boxes; null for none."""
    side = lambda i, of: of(F.transform(boxes, lambda b: b[i]))
    return F.when(F.size(boxes) > 0, F.array(side(0, F.array_min), side(1, F.array_min), side(2, F.array_max), side(3, F.array_max)))


def intersects(a: Column, b: Column, margin: float | Column = 0.0) -> Column:
    """Whether two boxes touch, the second grown on each side by ``margin`` of its width and height."""
    dx, dy = (b[2] - b[0]) * margin, (b[3] - b[1]) * margin
    return ~((a[2] < b[0] - dx) | (a[0] > b[2] + dx) | (a[3] < b[1] - dy) | (a[1] > b[3] + dy))


def near_same(a: Column, b: Column) -> Column:
    """Whether the centres of two boxes are within 0.35 of the greater width and 0.6 of the greater height, each at least 1."""
    far = lambda i: F.abs((a[i] + a[i + 2]) / 2 - (b[i] + b[i + 2]) / 2)
    size = lambda i: F.greatest(F.lit(1.0), a[i + 2] - a[i], b[i + 2] - b[i])
    return (far(0) <= size(0) * 0.35) & (far(1) <= size(1) * 0.60)


def distinct_boxes(boxes: Column) -> Column:
    """An array of boxes without those near an earlier one that stays, and without what isn't four numbers."""
    whole = F.filter(F.coalesce(boxes, F.array().cast(f"array<{BOX}>")), lambda b: F.size(b) == 4)
    return F.aggregate(whole, F.array().cast(f"array<{BOX}>"), lambda kept, b: F.when(F.exists(kept, lambda k: near_same(b, k)), kept).otherwise(F.concat(kept, F.array(b))))


def _windows(words: Column, starts: Column, n: Column) -> Column:
    return distinct_boxes(F.transform(starts, lambda i: union(F.transform(F.slice(words, i + 1, n), lambda w: w.box))))


def matched_boxes(df: DataFrame, query: str, words: str, within: str) -> DataFrame:
    """``df`` with ``exact`` and ``near``: boxes of the words in ``within`` that are the query's tokens, as they are or nearly.

    ``words`` is an array of struct (token, box) in reading order.  Near matches leave out short tokens of the query, and
    take none of eight or more.  Without tokens or a box there are none.
    """
    inside = F.filter(F.col(words), lambda w: intersects(w.box, F.col(within)))
    rows = df.withColumn("inside__", F.when(F.size(within) == 4, inside).otherwise(F.filter(words, lambda w: F.lit(False))))
    q = T.tokens(query)
    kept = F.filter(q, lambda t: (F.length(t) >= 3) | ((F.length(t) >= 2) & t.rlike("[0-9]")))
    rows = rows.withColumns({"exactly__": q, "nearly__": F.when(F.size(kept) < 8, kept).otherwise(F.array().cast("array<string>")), "tokens__": F.transform("inside__", lambda w: w.token)})

    def starts(tokens: list[str], query: list[str]) -> tuple:
        n = len(query)
        return ([i for i in range(len(tokens) - n + 1) if all(map(fuzzy.token_match, query, tokens[i : i + n]))] if n else [],)

    found = per_row(rows, starts, "starts__ array<int>", "tokens__", "nearly__")
    n = F.size("exactly__")
    places = F.when((n > 0) & (F.size("tokens__") >= n), F.filter(F.sequence(F.lit(0), F.size("tokens__") - n), lambda i: F.slice("tokens__", i + 1, n) == F.col("exactly__"))).otherwise(F.array().cast("array<int>"))
    made = found.withColumn("exact", _windows(F.col("inside__"), places, n)).withColumn("near", _windows(F.col("inside__"), F.col("starts__"), F.size("nearly__")))
    return made.drop("inside__", "exactly__", "nearly__", "tokens__", "starts__")


def hydrated(results: DataFrame, page_words: DataFrame, limit: int = 24) -> DataFrame:
    """``results`` with boxes, count and score of the words that match, for the first ``limit`` of those that ask for it.

    ``results``: ord, match_kind, chunk_type, query, file, page, box, match_boxes, match_count, score; ``page_words``: file,
    page, words.  Those with boxes, of metadata, of another kind, or without query, file or box are left as they are, as
    are those without a match.
    """
    asks = (F.size(F.coalesce("match_boxes", F.array().cast(f"array<{BOX}>"))) == 0) & (F.coalesce("chunk_type", F.lit("body")) != "metadata") & F.col("match_kind").isin("exact", "fuzzy")
    whole = (F.coalesce("query", F.lit("")) != "") & (F.coalesce("file", F.lit("")) != "") & (F.size("box") > 0)
    first = results.where(asks & whole).orderBy("ord").limit(limit).select("ord", "match_kind", "query", "file", "page", "box")
    found = matched_boxes(first.join(page_words, ["file", "page"]), "query", "words", "box")
    boxes = F.when(F.col("match_kind") == "exact", F.col("exact")).otherwise(F.col("near"))
    new = found.select(F.col("ord").alias("ord__"), boxes.alias("boxes__")).where(F.size("boxes__") > 0)
    has = F.col("ord__").isNotNull()
    both = results.join(F.broadcast(new), F.col("ord") == F.col("ord__"), "left")  # at most ``limit`` rows
    changed = {"match_boxes": F.col("boxes__"), "match_count": F.size("boxes__"), "score": F.size("boxes__").cast("double")}
    return both.select(*[F.when(has, changed[c]).otherwise(F.col(c)).alias(c) if c in changed else c for c in results.columns])


def region_of(box: Column, regions: Column) -> Column:
    """The type of the region that covers most of a box, over 0.3 of it; of nearly equal ones that of the higher priority.

    ``regions`` are taken in order, since a near tie is with the best so far.
    """
    priority = F.create_map(*[F.lit(x) for pair in PRIORITY for x in pair])
    area = F.greatest((box[2] - box[0]) * (box[3] - box[1]), F.lit(1.0))
    start = F.struct(F.lit(0.0).alias("ratio"), F.lit(-1).alias("priority"), F.lit("").alias("type"))

    def step(best: Column, r: Column) -> Column:
        w, h = (F.least(box[i + 2], r.bbox[i + 2]) - F.greatest(box[i], r.bbox[i]) for i in (0, 1))
        ratio, own = w * h / area, F.coalesce(priority[F.lower(r.type)], F.lit(0))
        better = (ratio > best.ratio) | ((F.abs(ratio - best.ratio) <= NEAR_TIE) & (own > best.priority))
        return F.when((w > 0) & (h > 0) & better, F.struct(ratio.alias("ratio"), own.alias("priority"), F.coalesce(r.type, F.lit("")).alias("type"))).otherwise(best)

    best = F.aggregate(regions, start, step)
    return F.when(best.ratio > LEAST_OVERLAP, best.type).otherwise(F.lit(""))


def words_in_region(words: Column, region: Column, margin: float = 0.10) -> Column:
    """The words (text, id, box) that touch a region grown by a margin, by lines of ten points, then from left to right."""
    touched = F.filter(words, lambda w: intersects(w.box, region, margin))
    place = lambda w: F.struct(F.bround((w.box[1] + w.box[3]) / 2 / 10.0).alias("row"), ((w.box[0] + w.box[2]) / 2).alias("x"))
    keyed = F.transform(touched, lambda w, i: F.struct(place(w).alias("place"), i.alias("i"), w.alias("word")))
    return F.transform(F.array_sort(keyed), lambda k: k.word)


def word_windows(df: DataFrame, words: str, most: int = MOST_WORDS) -> DataFrame:
    """``df`` with ``windows``: every run of up to ``most`` of the words (text, id, box), its joined text, box and word ids.

    Runs without text are left out.
    """

    def of(own: list[dict] | None) -> tuple:
        out, own = [], own or []
        for a in range(len(own)):
            texts, box = [], None
            for b in range(a, min(a + most, len(own))):
                w = own[b]
                box = list(w["box"]) if box is None else [*map(min, box[:2], w["box"][:2]), *map(max, box[2:], w["box"][2:])]
                if (w["text"] or "").strip():
                    texts.append(w["text"].strip())
                if texts:
                    out.append({"text": " ".join(texts), "box": box, "word_ids": [x["id"] for x in own[a : b + 1]]})
        return (out,)

    return per_row(df, of, f"windows array<struct<text:string,box:{BOX},word_ids:array<string>>>", words)


def visual_lines(words: list[dict]) -> list[list[dict]]:
    """Words (box, ord) as the lines that the eye sees: words of nearly one height, cut at wide gaps, from top to bottom.

    A word joins the first line whose mean height is within 2.5 points or 0.45 of its mean word height.  A gap is wide if it
    is over 12 points, three times the line's upper median gap and 0.75 of the two words' mean height.
    """
    rows: list[dict] = []
    for w in sorted(words, key=lambda w: ((w["box"][1] + w["box"][3]) / 2, w["box"][0])):
        x0, y0, x1, y1 = w["box"]
        middle, height = (y0 + y1) / 2, max(1.0, y1 - y0)
        own = next((r for r in rows if abs(middle - r["middles"] / len(r["words"])) <= max(2.5, 0.45 * max(1.0, r["heights"] / len(r["words"])))), None)
        if own is None:
            own = {"words": [], "middles": 0.0, "heights": 0.0}
            rows.append(own)
        own["words"].append((w, height))
        own["middles"] += middle
        own["heights"] += height

    def place(line: list[dict]) -> tuple:
        middle = (min(w["box"][1] for w in line) + max(w["box"][3] for w in line)) / 2
        return round(middle / 8.0), min(w["box"][0] for w in line), middle

    out = []
    for row in sorted((r["words"] for r in rows), key=lambda r: place([w for w, _ in r])):
        across = sorted(row, key=lambda x: (x[0]["box"][0], x[0]["box"][1], x[0]["ord"]))
        gaps = [b["box"][0] - a["box"][2] for (a, _), (b, _) in zip(across, across[1:], strict=False)]
        usual = sorted(max(0.0, g) for g in gaps)[len(gaps) // 2] if gaps else 0.0
        line = [across[0][0]]
        for gap, (_, h), (w, k) in zip(gaps, across, across[1:], strict=False):
            if gap > max(12.0, 3 * usual, 0.75 * (h + k) / 2):
                out.append(line)
                line = []
            line.append(w)
        out.append(line)
    return sorted(out, key=place)


def grouped_lines(pages: DataFrame, words: str) -> DataFrame:
    """``pages`` with ``places``: line and number within it of each word of ``words`` (array of struct box, ord), by ord."""

    def of(own: list[dict] | None) -> tuple:
        found = [(w["ord"], i, k) for i, line in enumerate(visual_lines(own or [])) for k, w in enumerate(line)]
        return ([{"ord": o, "line": i, "word": k} for o, i, k in sorted(found)],)

    return per_row(pages, of, "places array<struct<ord:bigint,line:int,word:int>>", words)


def fields_in_order(df: DataFrame, word_ids: str, words: str, line_order: str) -> DataFrame:
    """``df`` with ``field``: a field's words by line, then from left to right, their lines, least box, and text by lines.

    ``words`` is the page's array of struct (id, line_id, text, box), ``line_order`` its line ids from top to bottom.  Ids that
    the page hasn't, and repeats, are left out.
    """

    def of(ids: list[str] | None, own: list[dict] | None, order: list[str] | None) -> tuple:
        known, rank = {w["id"]: w for w in own or []}, {x: i for i, x in enumerate(order or [])}
        found = sorted((known[i] for i in dict.fromkeys(ids or []) if i in known), key=lambda w: (rank.get(w["line_id"], len(rank)), w["box"][0] if w["line_id"] in rank else w["box"][1], w["box"][0]))
        lines = list(dict.fromkeys(w["line_id"] for w in found if w["line_id"] is not None))
        text: dict[str | None, list[str]] = {}
        for w in found:
            if (w["text"] or "").strip():
                text.setdefault(w["line_id"], []).append(w["text"].strip())
        box = [f(w["box"][i] for w in found) for i, f in enumerate((min, min, max, max))] if found else None
        return ({"word_ids": [w["id"] for w in found], "line_ids": lines, "box": box, "text": "\n".join(" ".join(t) for t in text.values())},)

    return per_row(df, of, f"field struct<word_ids:array<string>,line_ids:array<string>,box:{BOX},text:string>", word_ids, words, line_order)


def grid_similarity(rows: DataFrame, key: str, gold: str, found: str, normalized) -> DataFrame:
    """(key, exact_rate, text_accuracy, same, cells) of two grids of cells, place by place over the larger of both.

    Cells are compared as ``normalized`` makes them; a blank gold cell is like a blank one only.  Two empty grids are the same.
    """
    width = lambda c: F.coalesce(F.array_max(F.transform(c, lambda r: F.size(r))), F.lit(0))
    sized = rows.select(key, gold, found, F.greatest(F.size(gold), F.size(found)).alias("rows__"), F.greatest(width(gold), width(found)).alias("cols__"), ((F.size(gold) == F.size(found)) & (width(gold) == width(found))).alias("shape__"))
    places = sized.withColumn("r__", F.explode_outer(F.when(F.col("rows__") > 0, F.sequence(F.lit(0), F.col("rows__") - 1)))).withColumn("c__", F.explode_outer(F.when(F.col("cols__") > 0, F.sequence(F.lit(0), F.col("cols__") - 1))))
    cell = lambda c: normalized(F.coalesce(F.get(F.get(c, F.col("r__")), F.col("c__")), F.lit("")))
    both = places.select(key, "shape__", F.col("c__").isNotNull().alias("is__"), cell(gold).alias("g__"), cell(found).alias("p__"))
    n = F.length("g__")
    like = F.when(n == 0, (F.length("p__") == 0).cast("double")).otherwise(F.greatest(F.lit(0.0), 1 - F.levenshtein("g__", "p__") / n))
    cells, same = F.count_if("is__"), F.count_if(F.col("is__") & (F.col("g__") == F.col("p__")))
    ratio = lambda x: F.when(cells > 0, x / cells).otherwise(F.lit(1.0))
    return both.groupBy(key).agg(ratio(same).alias("exact_rate"), ratio(F.sum(F.when(F.col("is__"), like))).alias("text_accuracy"), (F.first("shape__") & (same == cells)).alias("same"), cells.alias("cells"))
