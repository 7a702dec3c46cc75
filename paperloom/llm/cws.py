"""Document fingerprints by consistent weighted sampling, in DataFrame functions only.

For each of ``SAMPLES`` samples, a term with weight S draws r and c from Gamma(2, 1) and b from U(0, 1), all from hashes of
the term and the sample's number.  With t = floor(ln S / r + b), the term's value is ln a = ln c - r (t + 1 - b), and
the sample is the term with the least value.  That value depends on the term, the sample and t alone, so two documents
share it exactly when they share term and t, whose chance is their generalised Jaccard similarity
sum(min weight) / sum(max weight).  A term is a word in lower case; its weight is how often it occurs.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stage

SAMPLES = 32
#: Samples whose values one generated method computes; longer methods would not be compiled by the JVM.
TOGETHER = 4
#: Bytes of text in one partition, about.
PART_BYTES = 48 << 20
#: Ranges of doc_id at most whose bounds are quantiles of their own; more ranges are cut evenly between two of them.
BOUNDS = 4096
#: Bounds that are searched one by one, after a binary choice among lists of so many.
LISTED = 64
#: Ranges whose largest ids are broadcast at most, at some 30 bytes each; beyond it texts are shuffled to them.
MOST_BROADCAST = 1_000_000

_SPACES = r"[\x20\x09-\x0D]+"


def _below(bounds: list[float], at: int = 0) -> Column:
    """How many of the sorted bounds are at most doc_id, by binary choice."""
    if not bounds:
        return F.lit(at)
    mid = len(bounds) // 2
    return F.when(F.col("doc_id") < F.lit(bounds[mid]), _below(bounds[:mid], at)).otherwise(_below(bounds[mid + 1 :], at + mid + 1))


def range_of_id(df: DataFrame, parts: int) -> Column:
    """A number of about ``parts`` balanced ranges of doc_id that falls as doc_id rises; nulls have the highest."""
    known = df.where("doc_id is not null")
    cuts = min(parts, BOUNDS)
    found = sorted(set(known.approxQuantile("doc_id", [i / cuts for i in range(cuts + 1)], 1 / (8 * cuts))))
    if len(found) < 2:
        return F.when(F.col("doc_id").isNull(), F.lit(1)).otherwise(F.lit(0)).cast("long")
    inner = found[1:-1]
    lists = [inner[i : i + LISTED] for i in range(0, len(inner), LISTED)]
    which = _below([x[0] for x in lists[1:]])
    own = F.element_at(F.from_json(F.lit(json.dumps(lists or [[]])), "array<array<double>>"), which + 1)
    at = which * LISTED + F.size(F.filter(own, lambda x: x <= F.col("doc_id")))
    finer = -(-parts // cuts)
    if finer > 1:
        ends = F.from_json(F.lit(json.dumps(found)), "array<double>")
        low, high = F.element_at(ends, at + 1), F.element_at(ends, at + 2)
        at = at * finer + F.least(F.lit(finer - 1), F.greatest(F.lit(0), F.floor((F.col("doc_id") - low) / (high - low) * finer)))
    return F.when(F.col("doc_id").isNull(), F.lit(len(found) * finer + 1)).otherwise(F.lit(len(found) * finer) - at).cast("long")


def spread(spark: SparkSession, parts: int, count: int) -> list[int]:
    """Rising numbers, each ``parts`` of which hash partitioning deals to a partition each."""
    out: list[int] = []
    used: set[int] = set()
    at, step = 0, 16 * parts
    while len(out) < count:
        for k, p in spark.range(at, at + step, 1, 1).select("id", F.pmod(F.hash("id"), F.lit(parts))).collect():
            if p not in used and len(out) < count:
                out.append(k)
                used = used | {p} if len(used) + 1 < parts else set()
        at += step
    return out


def led(df: DataFrame, value: str, name: str, firsts: DataFrame) -> DataFrame:
    """``df`` (part, at, ...) with ``name``: ``value`` of the row with the next ``at``, of the next part's first, of the very first.

    ``firsts`` (giver, first) has each part's first value, which is handed to the part before it.
    """
    order, all_parts = Window.partitionBy("bucket").orderBy("own"), Window.partitionBy("bucket")  # a row for each part
    turn = firsts.select(F.col("giver").alias("own"), F.lit(0).alias("bucket")).select("own", F.coalesce(F.lead("own").over(order), F.min("own").over(all_parts)).alias("to"))
    handed = turn.join(firsts, F.col("to") == F.col("giver")).select("own", "first")
    within = F.lead(F.struct(value)).over(Window.partitionBy("part").orderBy("at"))
    both = df.withColumn("within", within).join(handed, F.col("part") == F.col("own"))
    return both.withColumn(name, F.when(F.col("within").isNull(), F.col("first")).otherwise(F.col(f"within.{value}"))).drop("within", "first", "own")


def first_texts(texts: DataFrame, ranges: int) -> DataFrame:
    """(giver, first): the text of the largest doc_id of each part, written to the shared folder."""
    tops = texts.groupBy("part").agg(F.max("doc_id").alias("top")).withColumnRenamed("part", "giver")
    rows = texts.join(F.broadcast(tops) if ranges <= MOST_BROADCAST else tops, (F.col("part") == F.col("giver")) & F.col("doc_id").eqNullSafe(F.col("top"))).select("giver", "text")
    turn = F.row_number().over(Window.partitionBy("giver").orderBy(F.xxhash64("text")))
    return stage(rows.withColumn("turn", turn).where("turn = 1").select("giver", F.col("text").alias("first")), "first-texts")


def edited_texts(docs: DataFrame, parts: int) -> DataFrame:
    """(part, at, doc_id, text, edited): the last third of each text replaced by the start of the next document's."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    number = range_of_id(texts, parts)
    if parts <= BOUNDS:
        number = F.element_at(F.from_json(F.lit(json.dumps(spread(docs.sparkSession, parts, parts + 3))), "array<bigint>"), (number + 1).cast("int"))
    dealt = texts.withColumn("part", number)
    firsts = first_texts(dealt, parts)
    order = Window.partitionBy("part").orderBy(F.col("doc_id").desc_nulls_last(), F.xxhash64("text"))
    both = led(dealt.repartition(parts, "part").withColumn("at", F.row_number().over(order)), "text", "following", firsts)
    third = "int(length(text) div 3)"
    return both.select("part", "at", "doc_id", "text", F.expr(f"concat(left(text, length(text) - {third}), left(following, {third}))").alias("edited"))


def weighted_terms(texts: DataFrame) -> DataFrame:
    """(part, at, term, o, e): how often a text, and its edited text, has each word.

    The words before the last white space of the common start count for both and are split once.
    """
    start = F.expr(r"regexp_extract(left(text, length(text) - int(length(text) div 3)), '(?s)^(.*[\\x20\\x09-\\x0D])', 1)")
    cut = texts.withColumn("start", start).select(
        "part", "at", F.explode(F.expr("array(struct(start as s, 1 as o, 1 as e), struct(substr(text, length(start) + 1) as s, 1 as o, 0 as e), struct(substr(edited, length(start) + 1) as s, 0 as o, 1 as e))")).alias("x")
    )
    words = cut.select("part", "at", "x.o", "x.e", F.explode(F.split("x.s", _SPACES)).alias("word")).where("word <> ''")
    return words.select("part", "at", F.xxhash64(F.lower("word")).alias("term"), "o", "e").groupBy("part", "at", "term").agg(F.sum("o").alias("o"), F.sum("e").alias("e"))


def _uniform(h: Column, shift: int) -> Column:
    """A number above 0 and below 1 from 26 bits of a hash."""
    return (F.shiftrightunsigned(h, shift).bitwiseAND(F.lit((1 << 26) - 1)) + F.lit(0.5)) / F.lit(float(1 << 26))


def least_values(terms: DataFrame, samples: int) -> DataFrame:
    """(part, at, set, o0.., e0..): the least value of each sample, for the text and for the edited text."""
    sets = F.explode(F.array(*[F.lit(k) for k in range(samples // TOGETHER)]))
    spread = terms.select("part", "at", "term", F.log("o").alias("lo"), F.log("e").alias("le"), sets.alias("set"))
    hashes = spread.select("*", *[F.xxhash64(F.col("set"), F.lit(2 * k + i), "term").alias(f"h{k}_{i}") for k in range(TOGETHER) for i in (0, 1)])
    drawn = hashes.select("part", "at", "set", "lo", "le", *[
        made
        for k in range(TOGETHER)
        for g, h in [(F.col(f"h{k}_0"), F.col(f"h{k}_1"))]
        for made in (
            (-F.log(_uniform(g, 0) * _uniform(g, 26))).alias(f"r{k}"),
            F.log(-F.log(_uniform(h, 0) * _uniform(h, 26))).alias(f"c{k}"),
            ((F.shiftrightunsigned(g, 52) * 4096 + F.shiftrightunsigned(h, 52) + F.lit(0.5)) / F.lit(float(1 << 24))).alias(f"b{k}"),
        )
    ])

    def value(weight: str, k: int) -> Column:
        return F.col(f"c{k}") - F.col(f"r{k}") * (F.floor(F.col(weight) / F.col(f"r{k}") + F.col(f"b{k}")) + 1 - F.col(f"b{k}"))

    return drawn.groupBy("part", "at", "set").agg(*[F.min(value(w, k)).alias(f"{a}{k}") for a, w in (("o", "lo"), ("e", "le")) for k in range(TOGETHER)])


def signatures(texts: DataFrame, samples: int) -> DataFrame:
    """(part, at, fingerprint, edited_fingerprint): four hex digits for each sample; absent if neither text has words."""

    def digits(a: str) -> Column:
        whole = [F.lpad(F.lower(F.hex(F.xxhash64(f"{a}{k}"))), 16, "0") for k in range(TOGETHER)]
        return F.concat(*[F.when(F.col(f"{a}{k}").isNull(), F.lit("0000")).otherwise(F.substring(w, 13, 4)) for k, w in enumerate(whole)])

    sets = least_values(weighted_terms(texts), samples).select("part", "at", F.struct("set", digits("o").alias("o"), digits("e").alias("e")).alias("x"))
    joined = sets.groupBy("part", "at").agg(F.array_sort(F.collect_list("x")).alias("x"))
    return joined.select("part", "at", F.array_join("x.o", "").alias("fingerprint"), F.array_join("x.e", "").alias("edited_fingerprint"))


def likeness(a: str, b: str, samples: int = SAMPLES) -> Column:
    """The share of samples that two fingerprints have in common."""
    same = [F.when(F.substring(a, 4 * k + 1, 4) == F.substring(b, 4 * k + 1, 4), 1).otherwise(0) for k in range(samples)]
    return sum(same[1:], same[0]) / F.lit(float(samples))


def fingerprints(docs: DataFrame, samples: int = SAMPLES, parts: int | None = None) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next), a row for each row of ``docs``.

    Null texts count as empty.  A text without words has the fingerprint of zeros, alike to any other such text.
    Rows are ordered by doc_id descending, nulls last, ties by text; wholly repeated rows give a row each.  A single
    row is its own next.  An empty table gives no rows.  Columns besides doc_id and text are not used.
    """
    if parts is None:
        size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
        parts = max(2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))
    texts = edited_texts(docs, parts)
    facts = texts.select("part", "at", "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"))
    none = F.lit("0000" * samples)
    both = facts.join(signatures(texts, samples), ["part", "at"], "left").select(*facts.columns, *[F.coalesce(c, none).alias(c) for c in ("fingerprint", "edited_fingerprint")])
    both = stage(both, "signatures")
    whole = led(both, "fingerprint", "next_fingerprint", both.where("at = 1").select(F.col("part").alias("giver"), F.col("fingerprint").alias("first")))
    return whole.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness("fingerprint", "edited_fingerprint", samples).alias("near_edited"), likeness("fingerprint", "next_fingerprint", samples).alias("near_next"))
