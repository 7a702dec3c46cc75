"""Stable ids and splits by digests, as Column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stable_id(c: Column | str) -> Column:
    return F.substring(F.sha1(c), 1, 16)


def _number(digest: Column, digits: int) -> Column:
    return F.conv(F.substring(digest, 1, digits), 16, 10).cast("long")


def seeded_split(c: Column, seed: str) -> Column:
    """0.8 training, 0.1 validation, 0.1 test, by twelve digits of SHA-1 over seed and key."""
    r = _number(F.sha1(F.concat(F.lit(f"{seed}:"), c)), 12) / F.lit(float(16**12 - 1))
    return F.when(r < 0.8, "train").when(r < 0.9, "val").otherwise("test")


def plain_split(c: Column, val: float = 0.1, test: float = 0.1) -> Column:
    """Tests first, then validation, by eight digits of SHA-1."""
    r = _number(F.sha1(c), 8) / F.lit(float(0xFFFFFFFF))
    return F.when(r < test, "test").when(r < test + val, "val").otherwise("train")


def modulo_split(c: Column) -> Column:
    """By eight digits of MD5, in thousandths."""
    r = _number(F.md5(c), 8) % 1000
    return F.when(r < 800, "train").when(r < 900, "val").otherwise("test")
