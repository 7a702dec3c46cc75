"""Evaluation measures over tables of gold and predicted values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def confusion(rows: DataFrame, gold: Column, predicted: Column, by: list[str] | None = None) -> DataFrame:
    """tp, fp, fn, tn, accuracy, precision, recall, f1 of boolean columns, for each group."""
    sums = [F.count_if(gold & predicted).alias("tp"), F.count_if(~gold & predicted).alias("fp"), F.count_if(gold & ~predicted).alias("fn"), F.count_if(~gold & ~predicted).alias("tn")]
    counted = rows.groupBy(*(by or [])).agg(*sums)
    tp, fp, fn, tn = map(F.col, ("tp", "fp", "fn", "tn"))
    return counted.withColumns({"accuracy": ratio(tp + tn, tp + fp + fn + tn), "precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn)})


def threshold_sweep(rows: DataFrame, gold: str, score: str, thresholds: list[float]) -> DataFrame:
    """Confusion at each threshold: a row gives one array of flags, so no grid is joined to the rows."""
    spread = rows.select(F.col(gold).alias("g"), F.col(score).alias("s"), F.explode(F.array(*map(F.lit, thresholds))).alias("threshold"))
    return confusion(spread, F.col("g"), F.col("s") >= F.col("threshold"), ["threshold"])


def best_threshold(sweep: DataFrame, min_recall: float) -> DataFrame:
    """The threshold with the best f1, then precision, recall, nearness to one half, of those with enough recall."""
    rank = F.struct("f1", "precision", "recall", (-F.abs(F.col("threshold") - 0.5)).alias("near"), (-F.col("threshold")).alias("low"))
    return sweep.where(F.col("recall") >= min_recall).agg(F.max_by(F.struct("threshold", "f1", "recall"), rank).alias("x")).select("x.*")


def area_under_curve(rows: DataFrame, gold: str, score: str, buckets: int = 4096) -> DataFrame:
    """ROC area by rank sums over distinct scores, ties counted half.

    Scores fall into ranges, so that a running sum never orders all of them in one task: first over the ranges, which
    are few, then within each.
    """
    by_score = rows.groupBy(F.col(score).alias("s")).agg(F.sum(F.col(gold).cast("long")).alias("p"), F.sum(1 - F.col(gold).cast("long")).alias("n"))
    ends = rows.agg(F.min(score).alias("low"), F.max(score).alias("high"))
    share = F.coalesce(F.try_divide(F.col("s") - F.col("low"), F.col("high") - F.col("low")), F.lit(0.0))
    ranged = by_score.crossJoin(F.broadcast(ends)).withColumn("range", F.floor(share * buckets))  # one row of ends
    sums = ranged.groupBy("range").agg(F.sum("n").alias("own"))
    before = sums.select("range", F.coalesce(F.sum("own").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    within = F.coalesce(F.sum("n").over(Window.partitionBy("range").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    both = ranged.withColumn("within", within).join(F.broadcast(before), "range")
    wins = F.col("p") * (F.col("before") + F.col("within") + F.col("n") / 2)
    return both.agg(F.try_divide(F.sum(wins), F.sum("p") * F.sum("n")).alias("auc"))


def top_k(rows: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each group."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def retrieval(hits: DataFrame, cuts: tuple[int, ...] = (1, 3, 5, 10), most: int = 20) -> DataFrame:
    """Hit rates at each cut and MRR over queries; ``hits`` (query, rank or null) has each query's first relevant rank."""
    rates = [F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0)).alias(f"recall_at_{k}") for k in cuts]
    return hits.agg(*rates, F.avg(F.when(F.col("rank") <= most, 1.0 / F.col("rank")).otherwise(0.0)).alias("mrr"))


def first_relevant(vectors: DataFrame, queries: DataFrame, most: int = 20, block: int = 2048) -> DataFrame:
    """(q, rank): the rank of each query's first vector of its label among its ``most`` nearest, null if none is.

    ``vectors``: vec_id, embedding, label; ``queries``: q, qe, ql.  Nearest by the dot product to six digits, ties by id; a query isn't its
    own neighbour.  Queries meet all vectors in blocks that are broadcast, and each task passes on ``most`` of a query.
    """
    dot = F.round(F.aggregate(F.zip_with("qe", "embedding", lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda a, x: a + x), 6)
    blocks = -(-queries.count() // block)
    found = None
    for turn in range(max(1, blocks)):
        own = queries if blocks < 2 else queries.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == turn)
        pairs = vectors.crossJoin(F.broadcast(own)).where("vec_id <> q").select("q", "vec_id", (F.col("label") == F.col("ql")).alias("same"), dot.alias("dot"))
        near = top_k(pairs, ["q"], [F.desc("dot"), F.col("vec_id")], most).where("same").groupBy("q").agg(F.min("rank").alias("rank"))
        found = near if found is None else found.unionByName(near)
    return queries.select("q").join(found, "q", "left")
