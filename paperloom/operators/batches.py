"""Rows through a Python function in Arrow batches, for rules that Column expressions can't state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

#: Bytes and rows of Arrow data that are Python objects at once; nested ones take some twenty times as much.
MOST_BYTES, MOST_ROWS = 1 << 20, 1000


def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches cut so that the mean part stays within MOST_BYTES and MOST_ROWS; a larger row stands alone."""
    for batch in batches:
        rows = max(1, min(MOST_ROWS, MOST_BYTES * batch.num_rows // max(1, batch.nbytes)))
        for a in range(0, batch.num_rows, rows):
            yield batch.slice(a, rows)


def arrow_types(made: StructType) -> list[pa.DataType]:
    return [to_arrow_type(f.dataType) for f in made]


def per_row(df: DataFrame, of: Callable[..., tuple], schema: str, *args: str) -> DataFrame:
    """``df`` with the columns of ``schema``: what ``of`` makes of the columns ``args`` of each row, which stays where it is."""
    made = StructType.fromDDL(schema)
    names, types = df.columns + made.names, arrow_types(made)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            rows = [of(*x) for x in zip(*(batch.column(a).to_pylist() for a in args), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([r[i] for r in rows], t) for i, t in enumerate(types))], names=names)

    return df.mapInArrow(run, StructType(df.schema.fields + made.fields))
