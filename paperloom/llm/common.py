"""Helpers shared by the training-data operators: tables, staging, word splitting, components."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in one Arrow batch; with whole texts the default of 10,000 rows is too much memory for a worker.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see, from ``spark.checkpoint.dir``; a folder of our own only where that is unset and all is one machine."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.conf.get("spark.master", "local")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = f"file://{tempfile.mkdtemp(prefix='paperloom-')}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as Parquet to the shared folder and rereads it: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def unstage(df: DataFrame) -> None:
    """Deletes the folder of a staged table that nothing reads any more."""
    path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(df.staged_at)
    path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def packed(docs: DataFrame, without: tuple[str, ...] = (), **named: Column) -> DataFrame:
    """The columns ``named``, and ``docs``' own but those ``without`` in a struct ``row``, where their names clash with none of ours."""
    own = [F.col(f"`{c}`") for c in docs.columns if c not in without]
    return docs.select(F.struct(*own, F.lit(0).alias("")).alias("row"), *[c.alias(n) for n, c in named.items()])


def unpacked(rows: DataFrame, names: list[str], **instead: Column) -> DataFrame:
    """The columns ``names`` out of ``row``, in order; those in ``instead`` are given anew."""
    return rows.select(*[instead.get(n, F.col(f"row.`{n}`")).alias(n) for n in names])


def small_batches(spark: SparkSession) -> None:
    """Keeps Arrow batches of whole texts small (session setting, read when a plan with Python runs)."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def give_back() -> None:
    """Returns freed memory to the system at a task's end: workers live on, idle, beside the stages that follow."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library only
    if trim:
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that the texts of a slice stay under ``most`` bytes (one longer text stands alone)."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start = total = 0
        for i, n in enumerate(sizes):
            if i > start and total + n > most:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if start < batch.num_rows:
            yield batch.slice(start)
    give_back()


def words_of(text: str | None) -> list[bytes]:
    """UTF-8 words of a text: A-Z lower-cased, separated by the six ASCII white-space characters; null: none."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of ``edges`` (a, b; longs) by alternating large-star and small-star steps.

    Returns (node, root) with the smallest node of each component as root; nodes without an edge are absent.
    Each round is written to the shared folder, so its lineage stays short.  A round joins edges with one
    aggregated row per node; no neighbourhood is ever collected, so a hub of any degree is only a skewed join.
    """

    def lowest(pairs: DataFrame) -> DataFrame:
        return pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())  # edges are distinct; a sum would overflow

    now = stage(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    was = mark(now)
    while was[0]:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = both.join(lowest(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = lowest(large)
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
        step = small.unionByName(low.select(F.col("u").alias("a"), F.col("m").alias("b"))).where("a <> b").distinct()
        before, now = now, stage(step, name)
        marked = mark(now)
        unstage(before)
        if marked == was:
            break
        was = marked
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
