"""WARC archives: writing records, and reading them back by boundary-chain verification.

Archives are uncompressed WARC 1.0 files of whatever size: a file is split by Spark's text reader at the record magic, so
several tasks read one file.  Every magic is only a candidate, since payloads may contain it too.  Each candidate
parses its own header and names its successor's offset; the records are those that pointer jumping reaches from the
start of the file.  Links within one split are followed in its task, so that only links over splits are jumped.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import shared_dir, stage, unstage

#: Fixed values of the format.
MAGIC = "WARC/1.0\r\n"
RECORD_END = "\r\n\r\n"
#: Equal payloads of at least so many bytes are stored once.
MIN_REVISIT_BYTES = 1000
#: Rounds of pointer jumping in one job, between two writes of the pointers.
ROUNDS = 2
#: Repeated payloads whose table is broadcast at most (under 100 bytes each); beyond it the pages are shuffled to it.
MOST_BROADCAST = 300_000
#: Records in one file; with more, a further file is begun.
MOST_RECORDS = 100_000


def planned_records(pages: DataFrame, least: int = MIN_REVISIT_BYTES) -> DataFrame:
    """(page_id, url, html, digest, bytes, type, refers_to): of equal payloads of ``least`` bytes the largest page_id responds."""
    full = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    known = full.withColumn("digest", F.sha1("html")).withColumn("bytes", F.octet_length("html").cast("long"))
    # Only payloads that repeat are joined: one row for each, so that a common one does not gather its pages anywhere.
    often = known.where(F.col("bytes") >= least).groupBy("digest", "bytes").agg(F.max("page_id").alias("top"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    often = stage(often, "warc-repeated")
    both = known.join(F.broadcast(often) if often.count() <= MOST_BROADCAST else often, ["digest", "bytes"], "left")
    again = F.col("top").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") < F.col("top")))
    return both.select("page_id", "url", "html", "digest", "bytes", F.when(again, F.lit("revisit")).otherwise(F.lit("response")).alias("type"), F.when(again, F.col("top")).alias("refers_to"))


def _record(r: DataFrame) -> Column:
    """The record of a row, without the closing blank lines.  Header values hold no line breaks."""

    def line(name: str, value: Column) -> Column:
        return F.when(value.isNull(), F.lit("")).otherwise(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")))

    url = F.regexp_replace("url", r"[\x00-\x20\x7f]", "%20")
    body = F.when(F.col("type") == "response", F.col("html")).otherwise(F.lit(""))
    head = F.concat(
        line("WARC-Type", F.col("type")),
        line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("none")), F.lit(">"))),
        line("WARC-Target-URI", F.when(url != "", url)),
        line("WARC-Date", F.lit("1970-01-01T00:00:00Z")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))),
        line("WARC-Profile", F.when(F.col("type") == "revisit", F.lit("http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"))),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.octet_length(body).cast("string")),
    )
    return F.concat(F.lit(MAGIC), head, F.lit("\r\n"), body)


def write_archives(pages: DataFrame, path: str | None = None, least: int = MIN_REVISIT_BYTES) -> str:
    """Writes one record for each row of ``pages`` (page_id, url, html) and returns the folder; a null html is empty.

    Rows with equal page_id and payload are all responses, as is any row alone.  An empty table gives empty archives.
    """
    spark = pages.sparkSession
    path = path or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    records = planned_records(pages, least)
    records.select(_record(records).alias("value")).write.option("lineSep", RECORD_END).option("maxRecordsPerFile", MOST_RECORDS).text(path)
    return path


def candidates(spark: SparkSession, paths: str | list[str], values: bool) -> DataFrame:
    """(file, block, base, at, head, length, next, digest, value): a row for each magic, its offset, header, and its successor's offset.

    The pieces between magics are all bytes of a file, so offsets are sums of lengths: first over the blocks of a
    file, whose sums are ``base``, then within a block.  A header that can't be parsed has no successor.  ``digest`` is the
    payload's, if it stands before the next magic; ``value``, all up to that magic, only if asked for.
    """
    raw = spark.read.option("lineSep", MAGIC).text(paths)
    read = raw.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("order"))
    blank = F.expr("instr(value, '\r\n\r\n')")
    head = F.when(blank > 0, F.expr("left(value, instr(value, '\r\n\r\n') + 1)"))
    length = F.nullif(F.regexp_extract("head", r"(?im)^Content-Length:[ \t]*([0-9]{1,18})[ \t]*\r?$", 1), F.lit("")).cast("long")
    begin = F.octet_length("head") + 2
    parsed = read.withColumn("size", F.octet_length("value").cast("long") + len(MAGIC)).withColumn("head", head).withColumn("length", length)
    digest = F.when(F.octet_length("value") >= begin + F.col("length"), F.expr("sha1(substr(cast(value as binary), octet_length(head) + 3, length))"))
    kept = ["file", "block", "order", "size", "head", "length", digest.alias("digest"), *(["value"] if values else [])]
    pieces = stage(parsed.select(*kept), "warc-pieces")
    blocks = pieces.groupBy("file", "block").agg(F.sum("size").alias("total"))
    before = F.sum("total").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    begun = blocks.withColumn("base", F.coalesce(before, F.lit(0)).cast("long")).drop("total")
    within = F.sum("size").over(Window.partitionBy("file", "block").orderBy("order").rowsBetween(Window.unboundedPreceding, -1))
    placed = pieces.withColumn("within", F.coalesce(within, F.lit(0)).cast("long")).join(begun, ["file", "block"])
    # The first piece of a file is what stands before its first magic (nothing, in a whole archive); others follow one.
    found = placed.withColumn("at", F.col("base") + F.col("within") - len(MAGIC)).where("at >= 0")
    end = F.col("at") + len(MAGIC) + begin + F.col("length") + len(RECORD_END)
    return found.select("file", "block", "base", "at", "head", "length", end.alias("next"), "digest", *(["value"] if values else []))


def _by_block(rows: DataFrame, of, schema: str) -> DataFrame:
    """Over rows (file, block, at, next, ...), sorted, what ``of`` makes of the columns of each block: numbers of one split."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            names = list(zip(batch.column("file").to_pylist(), batch.column("block").to_pylist(), strict=True))
            cuts = [0, *(i for i in range(1, len(names)) if names[i] != names[i - 1]), len(names)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if held and b > a and (held[0].column("file")[0].as_py(), held[0].column("block")[0].as_py()) != names[a]:
                    yield of(pa.Table.from_batches(held))
                    held = []
                if b > a:
                    held.append(batch.slice(a, b - a))
        if held:
            yield of(pa.Table.from_batches(held))

    return rows.repartition("file", "block").sortWithinPartitions("file", "block", "at").mapInArrow(run, schema)


def _numbers(rows: pa.Table, name: str) -> np.ndarray:
    """A column of offsets; nulls are -1."""
    return rows.column(name).combine_chunks().fill_null(-1).to_numpy()


def _exits(rows: pa.Table) -> pa.RecordBatch:
    """(file, block, at, exit): where the chain from each candidate leaves its block; -1: it ends within."""
    at, step = _numbers(rows, "at"), _numbers(rows, "next")
    last, out = at[-1], np.full(len(at), -1, np.int64)
    to = np.searchsorted(at, step)
    for i in range(len(at) - 1, -1, -1):
        if step[i] > last:
            out[i] = step[i]
        elif step[i] > at[i] and at[to[i]] == step[i]:
            out[i] = out[to[i]]
    first = rows.combine_chunks().to_batches()[0]
    return pa.RecordBatch.from_arrays([first.column("file"), first.column("block"), pa.array(at), pa.array(out)], names=["file", "block", "at", "exit"])


def _walked(rows: pa.Table) -> pa.RecordBatch:
    """(file, at, record): of each candidate from the entry on, the record that it belongs to; records are those of the chain."""
    at, step, entry = _numbers(rows, "at"), _numbers(rows, "next"), _numbers(rows, "entry")[0]
    chain, now = [], entry
    while True:
        i = int(np.searchsorted(at, now))
        if i == len(at) or at[i] != now:
            break
        chain.append(i)
        if step[i] <= now:
            break
        now = step[i]
    record = np.full(len(at), -1, np.int64)
    record[chain] = at[chain]
    record = np.maximum.accumulate(record)
    first = rows.combine_chunks().to_batches()[0]
    return pa.RecordBatch.from_arrays([first.column("file"), first.column("block"), pa.array(at), pa.array(record, mask=record < 0)], names=["file", "block", "at", "record"])


def reachable(links: DataFrame) -> DataFrame:
    """The (file, at) of ``links`` (file, at, next) that the chain from each file's start reaches, by pointer jumping.

    Each round every candidate learns whether it is reached and doubles its pointer, so n links take log2 n
    rounds.  A file must begin with a record.
    """
    known = links.select("file", F.col("at").alias("next"), F.lit(True).alias("known"))
    now = links.join(known, ["file", "next"], "left").select("file", "at", F.when(F.col("known"), F.col("next")).alias("to"), (F.col("at") == 0).alias("reached"))
    reached, before = -1, None
    while True:
        now = stage(now, "warc-chain")
        if before:
            unstage(before)
        found = now.where("reached").count()
        if found == reached:
            return now.where("reached").select("file", "at")
        reached, before = found, now
        for _ in range(ROUNDS):
            further = now.select("file", F.col("at").alias("to"), F.col("to").alias("further"))
            hit = now.where("reached and to is not null").select("file", F.col("to").alias("at"), F.lit(True).alias("hit"))
            moved = now.join(further, ["file", "to"], "left").select("file", "at", F.col("further").alias("to"), "reached")
            now = moved.join(hit, ["file", "at"], "left").select("file", "at", "to", (F.col("reached") | F.coalesce("hit", F.lit(False))).alias("reached"))


def records_of(found: DataFrame) -> DataFrame:
    """(file, at, record): for each candidate of ``found`` in the reach of the files' chains the record that it is, or is part of.

    Chains are followed within each block first.  Pointer jumping then goes from block to block, over those candidates alone
    at which some chain enters a block; each block that is reached is walked once more from its entry.
    """
    links = found.select("file", "block", "at", "next")
    exits = stage(_by_block(links, _exits, "file string, block long, at long, exit long"), "warc-exits")
    entered = exits.where("exit >= 0").select("file", F.col("exit").alias("at")).unionByName(exits.where("at = 0").select("file", "at")).distinct()
    doors = exits.join(entered, ["file", "at"], "left_semi").select("file", "at", F.when(F.col("exit") >= 0, F.col("exit")).alias("next"))
    reached = reachable(doors)
    # A block that no chain enters lies within the payload of the record before it.
    entries = exits.join(reached, ["file", "at"], "left_semi").groupBy("file", "block").agg(F.min("at").alias("entry"))
    walked = _by_block(links.join(entries, ["file", "block"]), _walked, "file string, block long, at long, record long")
    inside = links.join(entries, ["file", "block"], "left_anti").select("file", "block", "at", F.lit(None).cast("long").alias("record"))
    walked = stage(walked.unionByName(inside), "warc-walked")
    # Candidates before a block's entry belong to the last record of the blocks before it.
    ends = walked.groupBy("file", "block").agg(F.max("record").alias("last"))
    order = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("file", "block", F.last("last", ignorenulls=True).over(order).alias("carried"))
    return walked.join(carried, ["file", "block"]).select("file", "at", F.coalesce("record", "carried").alias("record")).where("record is not null")


def _fields(records: DataFrame) -> DataFrame:
    """(page_id, url, record_type, refers_to, noted, ...) from the headers."""

    def field(name: str) -> Column:
        return F.regexp_extract("head", rf"(?im)^{name}:[ \t]*([^\r\n]*?)[ \t]*\r?$", 1)

    def number(name: str) -> Column:
        return F.nullif(F.regexp_extract(field(name), r"page:(-?\d+)>", 1), F.lit("")).cast("long")

    rest = [c for c in records.columns if c != "head"]
    return records.select(number("WARC-Record-ID").alias("page_id"), field("WARC-Target-URI").alias("url"), field("WARC-Type").alias("record_type"), number("WARC-Refers-To").alias("refers_to"), F.regexp_replace(field("WARC-Payload-Digest"), "^sha1:", "").alias("noted"), *rest)


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload): the records of the archives at ``path``.

    Digests and lengths are of the stored payload.  That of a revisit is not stored with it: its length and digest
    are its response's, and its payload is null.  A file that doesn't begin with a record gives none; a cut or damaged file
    gives the records up to the damage, the last of them with what is left of its payload and no digest if that is short.
    Repeated records give a row each, a folder without records none.  Without ``payloads`` that column is left out, and
    texts are not moved.
    """
    found = stage(candidates(spark, path, payloads), "warc-candidates")
    # A candidate that is no record is part of the record before it.
    marked = records_of(found)
    marked = stage(marked, "warc-records")
    spread = marked.groupBy("file", "record").agg(F.count(F.lit(1)).alias("n"))
    alone = spread.where("n = 1").select("file", F.col("record").alias("at"))
    body = F.expr("substr(cast(value as binary), octet_length(head) + 3, length)")
    own = found.join(alone, ["file", "at"])
    records = own.select("head", "length", "digest", *([body.cast("string").alias("payload")] if payloads else []))
    broken = marked.join(spread.where("n > 1").select("file", "record"), ["file", "record"])
    if not broken.isEmpty():  # only their files are read again
        files = [r[0] for r in broken.select("file").distinct().collect()]
        texts = found if payloads else candidates(spark, files, True)
        joined = broken.join(texts, ["file", "at"]).groupBy("file", "record").agg(F.array_sort(F.collect_list(F.struct("at", "value", "head", "length"))).alias("x"))
        mended = joined.select(F.expr("x[0].head").alias("head"), F.expr("x[0].length").alias("length"), F.array_join("x.value", MAGIC).alias("value"))
        records = records.unionByName(mended.select("head", "length", F.sha1(body).alias("digest"), *([body.cast("string").alias("payload")] if payloads else [])))
    rows = stage(_fields(records), "warc-fields")
    full = rows.where("record_type <> 'revisit'")
    wanted = rows.where("record_type = 'revisit'").select(F.col("refers_to").alias("page_id"), F.col("noted").alias("digest")).distinct()
    theirs = full.select("page_id", "digest", "length").join(wanted, ["page_id", "digest"], "left_semi").distinct().select(F.col("page_id").alias("to"), F.col("digest").alias("their_digest"), F.col("length").alias("their_length"))
    both = rows.join(theirs, (F.col("refers_to") == F.col("to")) & (F.col("noted") == F.col("their_digest")), "left")
    again = F.col("record_type") == "revisit"
    out = both.select("page_id", "url", F.when(again, F.col("their_length")).otherwise(F.col("length")).alias("payload_bytes"), F.when(again, F.col("their_digest")).otherwise(F.col("digest")).alias("payload_digest"), "record_type", "refers_to", *([F.when(~again, F.col("payload")).alias("payload")] if payloads else []))
    return out
