"""Corpus-wide word tables: splitting by Arrow kernels, counting, and a head of proven size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, small_batches

#: The head has at most so many words of at most so many bytes each: under 40 MB with their values, at any corpus size.
HEAD_WORDS = 1 << 18
HEAD_BYTES = 64
#: Words with counts that a counting task holds before it passes them on.
HELD = 1 << 18


def chunks(texts: pa.Array, lower: bool = False) -> tuple[pa.Array, np.ndarray]:
    """The runs of characters other than ASCII white space of all texts, in order, and where each text's begin and end.

    With ``lower``, A-Z are lower-cased.  Null texts have none.
    """
    whole = pc.fill_null(texts, "")
    lists = pc.ascii_split_whitespace(pc.ascii_lower(whole) if lower else whole)
    flat, offsets = lists.flatten(), lists.offsets.to_numpy()
    full = pc.not_equal(flat, "")
    before = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
    return flat.filter(full), before[offsets - offsets[0]] if len(offsets) else np.zeros(1, np.int64)


def word_counts(docs: DataFrame, words_of: Callable[[pa.Array], list[pa.Array]] = lambda found: [found], lower: bool = False) -> DataFrame:
    """(word string, n long) over all words of all chunks of all texts; counted in each task first, then by one shuffle.

    ``words_of`` makes arrays of words of an array of chunks, place by place; an empty string is none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def out() -> Iterator[pa.RecordBatch]:
            if held:
                summed = pa.concat_tables(held).group_by("word", use_threads=False).aggregate([("n", "sum")])
                yield from summed.rename_columns({"n_sum": "n"}).select(["word", "n"]).to_batches(max_chunksize=1 << 16)
                held.clear()

        for batch in slices(batches):
            counted = pc.value_counts(chunks(batch.column("text"), lower)[0])
            for words in words_of(counted.field(0)):
                own = pa.table({"word": words, "n": counted.field(1)})
                held.append(own.filter(pc.not_equal(own["word"], "")))
            if sum(x.num_rows for x in held) > HELD:
                yield from out()
        yield from out()

    small_batches(docs.sparkSession)
    return docs.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def head(counts: DataFrame, columns: list[str], words: int = HEAD_WORDS) -> pa.Table:
    """The most frequent words of at most HEAD_BYTES bytes, ``words`` of them at most.

    Counts fall into bins of equal ratio, under 4,096 of them; the head is all words of the highest bins that fit.  So no
    task orders the words, as it would for the top of a sorted table.
    """
    bins = counts.where(F.octet_length("word") <= HEAD_BYTES).withColumn("bin", F.floor(F.log2("n") * 64))
    least, room = None, words
    for b, k in sorted(bins.groupBy("bin").agg(F.count(F.lit(1)).alias("k")).collect(), reverse=True):
        room -= k
        if room < 0:
            break
        least = b
    return bins.where(F.lit(False) if least is None else F.col("bin") >= least).select(*columns).toArrow()
