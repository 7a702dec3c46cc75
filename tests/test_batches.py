"""Batches of nested rows: what is held as Python objects at once stays bounded."""

from __future__ import annotations

import pyarrow as pa
from paperloom.operators import batches as X
from pyspark.sql import functions as F


def test_parts_are_bounded_by_bytes_and_rows():
    words = [[{"text": "x" * 20, "box": [0.0] * 4}] * 800] * 300
    batch = pa.RecordBatch.from_arrays([pa.array(words)], names=["words"])
    cut = list(X.parts([batch]))
    assert sum(x.num_rows for x in cut) == 300 and max(x.nbytes for x in cut) <= 1.1 * X.MOST_BYTES
    assert [x.num_rows for x in X.parts([pa.RecordBatch.from_arrays([pa.array(range(2500))], names=["n"])])] == [1000, 1000, 500]
    assert list(X.parts([batch.slice(0, 0)])) == []


def test_rows_of_pages_come_in_parts(spark):
    """A batch of pages of words is never whole as Python objects; before, all 3,000 rows were."""
    pages = spark.range(0, 3000, 1, 1).withColumn("words", F.transform(F.sequence(F.lit(0), F.lit(199)), lambda i: F.struct(F.concat(F.lit("w"), i).alias("id"), F.array(i * 1.0, i * 2.0).alias("box"))))

    live = {"n": 0}

    class Held(list):
        def __init__(self, x):
            super().__init__(x)
            live["n"] += 1
            self.most = live["n"]

        def __del__(self):
            live["n"] -= 1

    def of(words):
        kept = Held([len(words)])
        return ([kept.most], kept)  # rows of a part live together until the part is given on

    found = X.per_row(pages, of, "most array<int>, n array<int>", "words").agg(F.max(F.col("most")[0]).alias("most"), F.count(F.lit(1)).alias("rows"), F.min(F.col("n")[0]).alias("n")).first()
    assert (found.rows, found.n) == (3000, 200) and found.most < 500
