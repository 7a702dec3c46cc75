"""File sources and sinks: JSON, JSON lines, CSV, relevance tables, manifests, and wire-format messages."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_json(spark: SparkSession, path: str, schema: str, lines: bool = True) -> DataFrame:
    """Records by an explicit schema; broken ones become rows of nulls."""
    return spark.read.schema(schema).option("mode", "PERMISSIVE").option("multiLine", not lines).json(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_json_or(spark: SparkSession, path: str, schema: str, default: DataFrame) -> DataFrame:
    """The records at ``path``, or ``default`` if there is nothing."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)
    return read_json(spark, path, schema) if there else default


#: Begins a CSV file, so that spreadsheets take it for UTF-8.
MARK = "\ufeff"


def write_csv(df: DataFrame, path: str) -> None:
    """CSV files with a header and the mark of UTF-8 at their begin; quotes are doubled."""
    marked = df.withColumnRenamed(df.columns[0], MARK + df.columns[0])
    marked.write.mode("overwrite").option("header", True).option("encoding", "UTF-8").option("escape", '"').csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of CSV files with a header, which isn't compared with the schema's names."""
    return spark.read.schema(schema).option("header", True).option("enforceSchema", True).option("escape", '"').option("multiLine", True).csv(path)


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, doc_ids): the relevant documents of each query; rows of score 0 are left out."""
    rows = spark.read.option("sep", "\t").option("header", True).csv(path).toDF("query_id", "doc_id", "score")
    return rows.where("score <> '0'").groupBy("query_id").agg(F.array_sort(F.collect_set("doc_id")).alias("doc_ids"))


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, length, sha256) of all files below a folder."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return found.select("path", "length", F.sha2("content", 256).alias("sha256"))


def wire_fields(data: bytes) -> list[tuple[int, int, int | None, bytes | None]]:
    """(field, wire type, number, bytes) of a message without a schema; stops at the first broken field."""
    out, at = [], 0

    def varint(i: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (data[i] & 0x7F) << shift
            i, shift = i + 1, shift + 7
            if not data[i - 1] & 0x80:
                return value & (1 << 64) - 1, i

    try:
        while at < len(data):
            key, at = varint(at)
            kind = key & 7
            if kind == 0:
                number, at = varint(at)
                out.append((key >> 3, 0, number, None))
                continue
            size, at = varint(at) if kind == 2 else ({1: 8, 5: 4}[kind], at)
            if at + size > len(data):
                break
            out.append((key >> 3, kind, None if kind == 2 else int.from_bytes(data[at : at + size], "little"), data[at : at + size]))
            at += size
    except (IndexError, KeyError):
        pass
    return out


def decoded_messages(df: DataFrame, key: str, data: str) -> DataFrame:
    """(key, pos, field, kind, number, bytes): a row for each field of each message."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(k, i, *f) for k, d in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for i, f in enumerate(wire_fields(d or b""))]
            # Numbers of 64 bits are signed in a table.
            plain = [(k, i, f, t, None if n is None else n - (1 << 64) if n >> 63 else n, b) for k, i, f, t, n, b in rows]
            kinds = [batch.schema.field(0).type, pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in plain], t) for i, t in enumerate(kinds)], names=[key, "pos", "field", "kind", "number", "bytes"])

    return df.select(key, data).mapInArrow(run, f"`{key}` {dict(df.dtypes)[key]}, pos int, field int, kind int, number long, bytes binary")
