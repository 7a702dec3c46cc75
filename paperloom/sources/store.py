"""The archive's tables as one store: Parquet folders as views, their schemas and versions checked."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: The versions of the tables' schemas and of the chunker that this engine writes.
VERSIONS = {"schema_version": "8", "chunker_version": "1"}


def connect(spark: SparkSession, folder: str, tables: tuple[str, ...]) -> dict[str, DataFrame]:
    """The store's tables by name, each a view for SQL too; those that aren't there yet are left out.

    Views read the files as they are when a query runs; nothing is held open.
    """
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = {}
    for name in tables:
        if store.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.parquet")):
            found[name] = spark.read.parquet(f"{folder}/{name}.parquet")
            found[name].createOrReplaceTempView(name)
    return found


def schema_differences(df: DataFrame, expected: StructType) -> list[str]:
    """What a table lacks, has besides, or has of another type; nullability doesn't count."""
    own, wanted = ({f.name: f.dataType.simpleString() for f in s} for s in (df.schema, expected))
    return [f"{n}: {own.get(n)} instead of {wanted.get(n)}" for n in sorted(own.keys() | wanted.keys()) if own.get(n) != wanted.get(n)]


def ensured(meta: DataFrame, versions: dict[str, str] = VERSIONS) -> DataFrame:
    """``meta`` (key, value) with all versions, those there kept, and needs_migration: 1 if one there is another than ours, else 0.

    Nothing is deleted or changed for a store of other versions.
    """
    spark = meta.sparkSession
    ours = spark.createDataFrame(list(versions.items()), "key string, value string")
    other = meta.join(F.broadcast(ours.withColumnRenamed("value", "ours")), "key").agg(F.coalesce(F.max(F.col("value") != F.col("ours")), F.lit(False)).alias("x"))
    flag = other.select(F.lit("needs_migration").alias("key"), F.when(F.col("x"), "1").otherwise("0").alias("value"))
    return meta.where("key <> 'needs_migration'").unionByName(ours.join(meta, "key", "left_anti")).unionByName(flag)
