"""Cross-site line deduplication, in DataFrame functions only.

Occurrences of a line are first counted by line and site, within each task before any shuffle, so a line that stands in
a third of all documents is a row for each of its sites.  Lines that occur often enough to stand on many sites get a
HyperLogLog sketch of their sites, merged by aggregation.  A line whose estimate is far above or below the threshold is
decided by it; within a band around the threshold the distinct sites are counted exactly.  Boilerplate lines are then
removed wherever they repeat; occurrences never meet by their line's hash, unless that line is rare.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import packed, stage, unpacked

#: A line on so many distinct sites is boilerplate.
MIN_SITES = 8
#: log2 of the sketch's registers: a standard error of about 1.6 %.
SKETCH_BITS = 12
#: Estimates within this factor of the threshold are counted exactly; that is some 30 standard errors.
BAND = 1.5
#: Boilerplate lines are broadcast in the order of their counts, as many at most, of under 100 bytes each; the rest join by
#: a shuffle, and each of those has less than one in so many of all occurrences.
MOST_BROADCAST = 200_000


def exploded(docs: DataFrame) -> DataFrame:
    """(doc_id, tie, pos, site, h1, h2): a row for each non-blank line of each text, with 128 bits of hash of the trimmed line."""
    lines = docs.select("doc_id", F.xxhash64("text").alias("tie"), F.coalesce("source", F.lit("")).alias("site"), F.posexplode(F.split("text", "\n")).alias("pos", "raw"))
    trimmed = lines.select("doc_id", "tie", "pos", "site", F.trim("raw").alias("line")).where("line <> ''")
    return trimmed.select("doc_id", "tie", "pos", "site", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"))


def boilerplate(seen: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """(h1, h2, n, first): of ``seen`` (h1, h2, site, n, first) the lines on at least ``min_sites`` sites, their occurrences and first place."""
    # A line on so many sites has at least as many occurrences: all others are left out by a plain count.
    often = seen.groupBy("h1", "h2").agg(F.sum("n").alias("n"), F.min("first").alias("first")).where(F.col("n") >= min_sites)
    often = stage(often, "line-often")
    keys = often.select("h1", "h2")
    sites = seen.select("h1", "h2", "site").join(F.broadcast(keys) if often.count() <= MOST_BROADCAST else keys, ["h1", "h2"], "left_semi")
    sketched = stage(sites.groupBy("h1", "h2").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(SKETCH_BITS))).alias("estimate")), "line-sketches")
    near = sketched.where((F.col("estimate") > min_sites / BAND) & (F.col("estimate") < min_sites * BAND)).select("h1", "h2")
    exact = sites.join(near, ["h1", "h2"], "left_semi").groupBy("h1", "h2").agg(F.countDistinct("site").alias("sites"))
    decided = sketched.join(exact, ["h1", "h2"], "left").where(F.coalesce("sites", "estimate") >= min_sites).select("h1", "h2")
    return often.join(decided, ["h1", "h2"])


def repeated_places(docs: DataFrame, min_sites: int = MIN_SITES, most: int = MOST_BROADCAST) -> DataFrame:
    """(doc_id, tie, gone): the positions of boilerplate lines in each document that has any, but for each line's first place."""
    first = F.min(F.struct("doc_id", "tie", "pos")).alias("first")
    seen = stage(exploded(docs).groupBy("h1", "h2", "site").agg(F.count(F.lit(1)).alias("n"), first), "line-sites")
    found = stage(boilerplate(seen, min_sites), "line-boilerplate")
    lines = exploded(docs).drop("site")
    if found.count() <= most:
        places = lines.join(F.broadcast(found), ["h1", "h2"])
    else:
        # At most ``most`` lines can have one in ``most`` of all occurrences each.
        share = seen.agg(F.sum("n")).first()[0] / most
        heavy = F.broadcast(found.where(F.col("n") >= share))
        places = lines.join(heavy, ["h1", "h2"])
        rest = lines.join(heavy.select("h1", "h2"), ["h1", "h2"], "left_anti").join(found.where(F.col("n") < share), ["h1", "h2"])
        places = places.unionByName(rest)
    places = places.where(~F.struct("doc_id", "tie", "pos").eqNullSafe(F.col("first")))
    return places.groupBy("doc_id", "tie").agg(F.collect_set("pos").alias("gone"))


def deduplicated(docs: DataFrame, min_sites: int = MIN_SITES, removed: str | None = "n_removed", most: int = MOST_BROADCAST) -> DataFrame:
    """``docs`` with boilerplate lines taken out of ``text``, and the column ``removed`` (None: none): how many lines that were.

    A line counts by its text without outer spaces; blank lines are never boilerplate.  Of each boilerplate line the
    first place by (doc_id, text hash, position) stays, so nothing is lost from the corpus; ties are wholly repeated rows,
    which count as one document and are treated alike.  A null source is one site of its own.  Null and empty texts stay
    as they are, and null ids name one document for each text.  Other columns pass through, whatever their names; one
    named ``removed`` is given anew.  An empty table gives no rows.
    """
    names = [c for c in docs.columns if c != removed]
    gone = repeated_places(docs.select("doc_id", "text", "source"), min_sites, most).select(F.col("doc_id").alias("d"), F.col("tie").alias("t"), "gone")
    rows = packed(docs, ("text",), id=F.col("doc_id"), text=F.col("text"), tie=F.xxhash64("text"))
    both = rows.join(gone, F.col("id").eqNullSafe(F.col("d")) & (F.col("tie") == F.col("t")), "left")
    both = both.withColumn("lines", F.when(F.col("gone").isNotNull(), F.split("text", "\n")))
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone"), lambda i: F.element_at(F.col("lines"), i + 1))
    cleaned = both.withColumn("cleaned", F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")))
    number = F.when(F.col("gone").isNull(), F.lit(0)).otherwise(F.size("gone")).cast("long")
    if removed is None:
        return unpacked(cleaned, names, text=F.col("cleaned"))
    return unpacked(cleaned, [*names, removed], text=F.col("cleaned"), **{removed: number})
