"""Operators whose result depends on the order of their rows, a group at a time.

A group's rows come as one sorted array, so that a task works through many groups in an Arrow batch.  Groups are rows of
a page, a document or a case, whose size is bounded by these.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fold_groups(rows: DataFrame, by: str, columns: list[str], fold: Callable[[list[tuple]], Iterable[tuple]], schema: str) -> DataFrame:
    """(by, ...schema): what ``fold`` makes of each group's rows, sorted by ``columns``."""
    names = [x.split()[0] for x in schema.split(", ")]
    types = {"long": pa.int64(), "double": pa.float64(), "string": pa.string(), "int": pa.int32()}
    kinds = [types[x.split()[1]] for x in schema.split(", ")]
    groups = rows.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("rows"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, out = [], []
            for key, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                made = list(fold([tuple(r.values()) for r in own]))
                keys += [key] * len(made)
                out += made
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.schema.field(0).type), *(pa.array([r[i] for r in out], t) for i, t in enumerate(kinds))], names=[by, *names])

    return groups.mapInArrow(run, f"`{by}` {dict(rows.dtypes)[by]}, {schema}")


def iou(a: tuple, b: tuple) -> float:
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    common = max(0.0, w) * max(0.0, h)
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - common
    return common / union if union > 0 else 0.0


def suppressed(boxes: DataFrame, by: str, key: str, score: str, most: float) -> DataFrame:
    """(by, key) of boxes x0, y0, x1, y1 that no better kept box of the group overlaps by more than ``most``; ties by key."""

    def keep(rows: list[tuple]) -> Iterator[tuple]:
        kept: list[tuple] = []
        for _, k, *box in rows:
            if all(iou(box, b) <= most for b in kept):
                kept.append(tuple(box))
                yield (k,)

    ordered = boxes.withColumn("__worse", -F.col(score))
    return fold_groups(ordered, by, ["__worse", key, "x0", "y0", "x1", "y1"], keep, f"{key} long")


def suppressed_intervals(items: DataFrame, by: str, key: str, score: str, most: float) -> DataFrame:
    """(by, key) of intervals a, b that no better kept one overlaps by more than ``most`` of the shorter."""

    def keep(rows: list[tuple]) -> Iterator[tuple]:
        kept: list[tuple] = []
        for _, k, a, b in rows:
            if all(min(b, d) - max(a, c) <= most * max(1e-9, min(b - a, d - c)) for c, d in kept):
                kept.append((a, b))
                yield (k,)

    return fold_groups(items.withColumn("__worse", -F.col(score)), by, ["__worse", key, "a", "b"], keep, f"{key} long")


def matched(pairs: DataFrame, by: str, left: str, right: str, weight: str) -> DataFrame:
    """(by, left, right): each left in turn takes the free right of the greatest weight, the first of equals."""

    def take(rows: list[tuple]) -> Iterator[tuple]:
        used: set = set()
        best: dict = {}
        for k in dict.fromkeys(r[0] for r in rows):
            free = [(w, r) for x, r, w in rows if x == k and r not in used and w > 0]
            if free:
                best[k] = max(free, key=lambda x: x[0])[1]
                used.add(best[k])
        yield from best.items()

    return fold_groups(pairs, by, [left, right, weight], take, f"{left} long, {right} long")


def chunked(lines: DataFrame, least: int = 30, target: int = 100, most: int = 250) -> DataFrame:
    """(doc_id, chunk, first, last, words): lines of a page merged into chunks of about ``target`` words, tiny ends folded back."""

    def fold(rows: list[tuple]) -> Iterator[tuple]:
        out: list[list] = []
        for pos, page, n in rows:
            last = out[-1] if out and out[-1][0] == page and out[-1][3] + n <= most else None
            if last and (n < least or last[3] < target):
                last[2], last[3] = pos, last[3] + n
            else:
                out.append([page, pos, pos, n])
        return ((i, first, last, n) for i, (_, first, last, n) in enumerate(out))

    sized = lines.select("doc_id", "pos", "page", F.size(F.filter(F.split("line", r"\s+"), lambda w: w != "")).alias("n"))
    return fold_groups(sized, "doc_id", ["pos", "page", "n"], fold, "chunk long, first long, last long, words long")


def reading_order(boxes: DataFrame, by: str, key: str, tolerance: float = 0.2) -> DataFrame:
    """(by, key, rank): rows of boxes whose tops lie above the running bottom, within a tolerance, go left to right."""

    def order(rows: list[tuple]) -> Iterator[tuple]:
        bands: list[list] = []
        bottom = float("-inf")
        for y0, x0, y1, k in rows:
            if bands and y0 < bottom - tolerance * (y1 - y0):
                bands[-1].append((x0, y0, k))
                bottom = max(bottom, y1)
            else:
                bands.append([(x0, y0, k)])
                bottom = y1
        return ((k, i) for i, (_, _, k) in enumerate(b for band in bands for b in sorted(band)))

    return fold_groups(boxes, by, ["y0", "x0", "y1", key], order, f"{key} long, rank long")


def xy_cut(boxes: DataFrame, by: str, key: str, gap: float = 10.0) -> DataFrame:
    """(by, key, rank): recursive cuts of a page at its widest empty band, across before down."""

    def split(rows: list[tuple], a: int, b: int) -> list[list[tuple]]:
        parts, reach = [], float("-inf")
        for r in sorted(rows, key=lambda r: (r[a], r[4])):
            if parts and r[a] < reach + gap:
                parts[-1].append(r)
            else:
                parts.append([r])
            reach = max(reach, r[b])
        return parts

    def order(rows: list[tuple]) -> Iterator[tuple]:
        out, todo = [], [rows]
        while todo:
            own = todo.pop()
            for a, b in ((1, 3), (0, 2)):
                parts = split(own, a, b)
                if len(parts) > 1:
                    todo += reversed(parts)
                    break
            else:
                out += sorted(own, key=lambda r: (r[1], r[0], r[4]))
        return ((r[4], i) for i, r in enumerate(out))

    return fold_groups(boxes, by, ["x0", "y0", "x1", "y1", key], order, f"{key} long, rank long")


def detections(gold: DataFrame, predicted: DataFrame, by: str, least: float = 0.5) -> DataFrame:
    """(by, tp, fp, fn, mean_iou): each gold box in turn takes the free prediction of the greatest overlap from ``least``."""

    def score(rows: list[tuple]) -> Iterator[tuple]:
        golds, free = [r[2:] for r in rows if r[0] == 0], [r[2:] for r in rows if r[0] == 1]
        found = []
        for g in golds:
            best = max(free, key=lambda p: iou(g, p), default=None)
            if best is not None and iou(g, best) >= least:
                found.append(iou(g, best))
                free.remove(best)
        yield len(found), len(free), len(golds) - len(found), sum(found) / len(found) if found else 0.0

    box = ["ord", "x0", "y0", "x1", "y1"]
    both = gold.select(by, F.lit(0).alias("side"), *box).unionByName(predicted.select(by, F.lit(1).alias("side"), *box))
    return fold_groups(both, by, ["side", *box], score, "tp long, fp long, fn long, mean_iou double")
