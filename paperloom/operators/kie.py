"""Measures of labelled spans: word counts by field, matched spans, thresholds by coordinate search, choice of documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .batches import per_row
from .greedy import iou

SPAN = "struct<word_ids:array<string>,box:array<double>>"


def label_field(label: Column) -> Column:
    """The field of a tag without its B- or I-; O stays."""
    return F.regexp_replace(label, "^[BI]-", "")


def word_counts(rows: DataFrame, gold: str, predicted: str) -> DataFrame:
    """(field, gold, pred, tp, fp, fn) over arrays of tags, position by position up to the shorter; the null field is overall.

    A gold word with another field predicted is missed for its own and wrong for the other; overall both count.
    """
    n = F.least(F.size(gold), F.size(predicted))
    pairs = rows.select(F.explode(F.slice(F.arrays_zip(F.transform(gold, label_field).alias("g"), F.transform(predicted, label_field).alias("p")), F.lit(1), n)).alias("x")).select("x.g", "x.p")
    one = lambda field, gold, pred, tp, fp, fn: F.struct(field.alias("field"), *[c.cast("long").alias(k) for k, c in (("gold", gold), ("pred", pred), ("tp", tp), ("fp", fp), ("fn", fn))])
    g, p, no = F.col("g"), F.col("p"), F.lit(0)
    each = F.array(one(g, F.lit(1), no, no, no, g != p), one(p, no, F.lit(1), g == p, g != p, no))
    return pairs.select(F.inline(each)).where("field <> 'O'").rollup("field").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("gold", "pred", "tp", "fp", "fn")])


def matched_spans(gold: list[dict], predicted: list[dict]) -> dict:
    """Counts of one document's spans of a field: each gold span takes an equal prediction, else the free one with most common words.

    Taken in order; of equal overlaps the first.  Words and boxes of what is only partly right count as missing and extra.
    """
    free = list(predicted)
    words = lambda s: set(s["word_ids"] or [])
    out = {"tp": 0, "fp": 0, "fn": 0, "missing": 0, "extra": 0, "gold_words": sum(len(g["word_ids"] or []) for g in gold), "pred_words": sum(len(p["word_ids"] or []) for p in predicted), "ious": []}
    for g in gold:
        same = next((p for p in free if p["word_ids"] == g["word_ids"]), None)
        if same is not None:
            free.remove(same)
            out["tp"] += 1
            out["ious"].append(1.0)
            continue
        out["fn"] += 1
        best = max(free, key=lambda p: len(words(g) & words(p)), default=None)
        if best is not None and words(g) & words(best):
            free.remove(best)
            out["missing"] += len(words(g) - words(best))
            out["extra"] += len(words(best) - words(g))
            out["ious"].append(iou(tuple(g["box"]), tuple(best["box"])) if g["box"] and best["box"] else 0.0)
        else:
            out["missing"] += len(words(g))
    out["fp"] = len(free)
    out["extra"] += sum(len(p["word_ids"] or []) for p in free)
    return out


def span_metrics(groups: DataFrame, gold: str, predicted: str) -> DataFrame:
    """(field, precision, recall, f1, exact, missing_rate, extra_rate, mean_iou) of rows (field, gold, predicted; one for each document).

    Spans match within their document.  The null field is overall.  Ratios are 0 where there is nothing to divide by.
    """
    schema = "m struct<tp:bigint,fp:bigint,fn:bigint,missing:bigint,extra:bigint,gold_words:bigint,pred_words:bigint,ious:array<double>>"
    made = per_row(groups.select("field", gold, predicted), lambda g, p: (matched_spans(g or [], p or []),), schema, gold, predicted).select("field", "m.*")
    total = F.aggregate("ious", F.lit(0.0), lambda a, x: a + x)
    sums = made.rollup("field").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "missing", "extra", "gold_words", "pred_words")], F.sum(total).alias("iou"), F.sum(F.size("ious")).alias("n"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return sums.select(
        "field", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), ratio(tp, tp + fn).alias("exact"),
        ratio(F.col("missing"), F.col("gold_words")).alias("missing_rate"), ratio(F.col("extra"), F.col("pred_words")).alias("extra_rate"), ratio(F.col("iou"), F.col("n")).alias("mean_iou"),
    )


def tuned_thresholds(evaluate: Callable[[list[dict]], list[float]], base: dict[str, float], grids: dict[str, list[float]], passes: int = 2) -> tuple[dict[str, float], float]:
    """Thresholds by coordinate search, and their objective: each field in turn takes the best of its grid, for some passes.

    ``evaluate`` gives the objectives of several settings at once, so that a field costs one job.  Only a gain over 1e-9
    changes a threshold, the first of equal ones wins; a pass without a change is the last.
    """
    now = dict(base)
    best = evaluate([now])[0]
    for _ in range(passes):
        before = dict(now)
        for field, grid in grids.items():
            for value, objective in zip(grid, evaluate([now | {field: v} for v in grid]) if grid else [], strict=True):
                if objective > best + 1e-9:
                    best, now = objective, now | {field: value}
        if now == before:
            break
    return now, best


def threshold_objectives(candidates: DataFrame, settings: list[dict[str, float]]) -> list[float]:
    """The F1 of each setting over ``candidates`` (field, score, gold): those at their field's threshold or above are taken."""
    rows = [(i, f, float(t)) for i, s in enumerate(settings) for f, t in s.items()]
    grid = candidates.sparkSession.createDataFrame(rows, "setting int, field string, least double")
    # Scores are binned by the settings' own thresholds, so that each candidate is counted once, whatever the settings.
    cuts = candidates.join(F.broadcast(grid.groupBy("field").agg(F.sort_array(F.collect_set("least")).alias("cuts"))), "field")
    bins = cuts.groupBy("field", F.size(F.filter("cuts", lambda c: c <= F.col("score"))).alias("bin"), "cuts").agg(F.count_if("gold").alias("good"), F.count_if(~F.col("gold")).alias("bad"))
    taken = bins.join(F.broadcast(grid), "field").withColumn("in", F.col("bin") > F.array_position("cuts", F.col("least")) - 1)
    sums = taken.groupBy("setting").agg(F.sum(F.when(F.col("in"), F.col("good")).otherwise(0)).alias("tp"), F.sum(F.when(F.col("in"), F.col("bad")).otherwise(0)).alias("fp"), F.sum(F.when(~F.col("in"), F.col("good")).otherwise(0)).alias("fn")).collect()
    found = {r.setting: 2 * r.tp / max(1, 2 * r.tp + r.fp + r.fn) for r in sums}
    return [found.get(i, 0.0) for i in range(len(settings))]


def selected_documents(docs: DataFrame, count: int, least_multipage: int) -> DataFrame:
    """``count`` of ``docs`` (doc_id, pages, path): some of several pages, then those of one page, then the others, by pages and path.

    Raises if there are fewer.
    """
    most = max(count, least_multipage)
    first = lambda kind: docs.where(kind).orderBy("pages", "path").limit(most)
    several = first("pages > 1").withColumn("rank__", F.row_number().over(Window.orderBy("pages", "path")))  # ``most`` rows
    kinds = several.withColumn("kind__", F.when(F.col("rank__") <= least_multipage, 0).otherwise(2)).drop("rank__").unionByName(first("pages <= 1").withColumn("kind__", F.lit(1)))
    chosen = kinds.orderBy("kind__", "pages", "path").limit(count).drop("kind__")
    if chosen.count() != count:
        raise ValueError(f"fewer than {count} documents")
    return chosen
