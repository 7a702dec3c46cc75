"""Boxes as Column builders.  A box is four columns x0, y0, x1, y1 with a common prefix."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SIDES = ("x0", "y0", "x1", "y1")


def sides(prefix: str) -> list[Column]:
    return [F.col(f"{prefix}{s}") for s in SIDES]


def area(prefix: str) -> Column:
    x0, y0, x1, y1 = sides(prefix)
    return F.greatest(F.lit(0.0), x1 - x0) * F.greatest(F.lit(0.0), y1 - y0)


def intersection(a: str, b: str) -> Column:
    """Common area, 0 for boxes that only touch."""
    ax0, ay0, ax1, ay1 = sides(a)
    bx0, by0, bx1, by1 = sides(b)
    return F.greatest(F.lit(0.0), F.least(ax1, bx1) - F.greatest(ax0, bx0)) * F.greatest(F.lit(0.0), F.least(ay1, by1) - F.greatest(ay0, by0))


def iou(a: str, b: str) -> Column:
    union = area(a) + area(b) - intersection(a, b)
    return F.when(union > 0, intersection(a, b) / union).otherwise(F.lit(0.0))


def coverage(a: str, b: str) -> Column:
    """The share of box a that box b covers."""
    return F.when(area(a) > 0, intersection(a, b) / area(a)).otherwise(F.lit(0.0))


def x_overlap(a: str, b: str) -> Column:
    """Common width over the smaller width."""
    ax0, _, ax1, _ = sides(a)
    bx0, _, bx1, _ = sides(b)
    least = F.least(ax1 - ax0, bx1 - bx0)
    return F.when(least > 0, F.greatest(F.lit(0.0), F.least(ax1, bx1) - F.greatest(ax0, bx0)) / least).otherwise(F.lit(0.0))


def normalized(x: Column, size: Column) -> Column:
    """0 to 1000, rounded half to even, clamped."""
    return F.least(F.lit(1000), F.greatest(F.lit(0), F.bround(x / size * 1000, 0).cast("int")))


def bucket(x: Column, low: float, high: float, bins: int) -> Column:
    """Clamped equal-width buckets 0 .. bins-1 by rounding half to even."""
    share = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (x - low) / (high - low)))
    return F.bround(share * (bins - 1), 0).cast("int")


def clamp01(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))
