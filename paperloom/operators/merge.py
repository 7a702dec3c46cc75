"""Merges over immutable tables: each returns the state after the change."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in ``order``."""
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__r = 1").drop("__r")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep: list[str], overwrite: list[str]) -> DataFrame:
    """``keep`` columns take new values unless these are null or blank, ``overwrite`` columns take any; keys of either side stay."""
    o, n = old.alias("o"), new.withColumn("__new", F.lit(True)).alias("n")
    both = o.join(n, [F.col(f"o.{k}") == F.col(f"n.{k}") for k in keys], "full")
    key = [F.coalesce(f"o.{k}", f"n.{k}").alias(k) for k in keys]
    kept = [F.coalesce(F.nullif(f"n.{c}", F.lit("")), F.col(f"o.{c}")).alias(c) for c in keep]
    return both.select(*key, *kept, *[F.when(F.col("n.__new"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in overwrite])


def deleted(rows: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` without those whose key is in ``gone``."""
    return rows.join(gone, keys, "left_anti")


def soft_field(c: Column | str, most: int) -> Column:
    """Trimmed, capped at ``most`` characters; blank becomes null."""
    return F.nullif(F.left(F.trim(c), F.lit(most)), F.lit(""))


def violations(rules: dict[str, DataFrame]) -> DataFrame:
    """The rows that each rule rejects, with the rule's name."""
    return reduce(DataFrame.unionByName, [rows.withColumn("rule", F.lit(name)) for name, rows in rules.items()])


def begun(history: DataFrame, source: str, now: int) -> DataFrame:
    """``history`` (import_id, source, started_at, status) with a running import of the next number."""
    number = history.agg((F.coalesce(F.max("import_id"), F.lit(0)) + 1).cast("long").alias("import_id"))
    return history.unionByName(number.select("import_id", F.lit(source).alias("source"), F.lit(now).cast("long").alias("started_at"), F.lit("running").alias("status")))


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that all executors see, below ``spark.checkpoint.dir``; a local one only on a single machine without that."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.conf.get("spark.master", "local").startswith("local") or spark.conf.get("spark.master").startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = f"file://{tempfile.gettempdir()}"
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def committed(df: DataFrame, path: str) -> DataFrame:
    """Writes ``df`` as the next version below ``path`` and returns the last version; readers of older ones aren't disturbed."""
    spark = df.sparkSession
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    known = [f.getPath().getName() for f in store.listStatus(folder)] if store.exists(folder) else []
    last = max((int(n[8:]) for n in known if n.startswith("version=")), default=0)
    target = f"{path}/version={last + 1}"
    df.write.parquet(target)
    return spark.read.schema(df.schema).parquet(target)


def edited(docs: DataFrame, edits: DataFrame, columns: list[str], key: str, annotation: str = "annotation") -> DataFrame:
    """``docs`` with the columns of ``edits`` in place of their own, and the same texts in their annotation; ``edited`` says where.

    The annotation is JSON with field_instances: those of an edited label keep all but their text, labels without an instance
    get one if the text isn't blank.  Broken or missing annotations begin anew.  Subjects lose a repeated type at their front
    elsewhere; here texts come as they are to be stored.
    """
    kind = "array<struct<label:string,text:string,page_index:int,bbox:array<double>,field_id:string,score:double,source:string>>"
    new = edits.select(key, *[F.coalesce(c, F.lit("")).alias(f"{c}__") for c in columns], F.lit(True).alias("edited__"))
    both = docs.join(new, key, "left")
    label = lambda c: c.upper()
    texts = F.create_map(*[x for c in columns for x in (F.lit(label(c)), F.col(f"{c}__"))])
    own = F.coalesce(F.from_json(F.get_json_object(annotation, "$.field_instances"), kind), F.array().cast(kind))
    changed = F.transform(own, lambda f: F.when(texts[f.label].isNotNull(), f.withField("text", texts[f.label])).otherwise(f))
    made = F.array(*[
        F.struct(F.lit(label(c)).alias("label"), F.col(f"{c}__").alias("text"), F.lit(0).alias("page_index"), F.array(*[F.lit(0.0)] * 4).alias("bbox"), F.lit(f"{c}_user_edit").alias("field_id"), F.lit(1.0).alias("score"), F.lit("user_edit").alias("source"))
        for c in columns
    ])
    added = F.filter(made, lambda f: (f.text != "") & ~F.exists(own, lambda o: o.label == f.label))
    is_new = F.coalesce("edited__", F.lit(False))
    json = F.to_json(F.struct(F.concat(changed, added.cast(kind)).alias("field_instances")))
    value = {**{c: F.when(is_new, F.col(f"{c}__")).otherwise(F.col(c)) for c in columns}, annotation: F.when(is_new, json).otherwise(F.col(annotation))}
    return both.select(*[value.get(c, F.col(c)).alias(c) for c in docs.columns], is_new.alias("edited"))
