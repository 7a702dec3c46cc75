"""Functions registered for SQL."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql.functions import pandas_udf, udtf
from pyspark.sql.types import ArrayType, StringType

from . import fuzzy


@udtf(returnType="place: int, size: int, gram: string")
class Ngrams:
    """Runs of up to ``most`` folded tokens of a text, by place and size; none of a null text."""

    def eval(self, text: str, most: int) -> Iterator[tuple[int, int, str]]:
        tokens = fuzzy.folded_tokens(text)
        for i in range(len(tokens)):
            for n in range(1, min(most or 0, len(tokens) - i) + 1):
                yield i, n, " ".join(tokens[i : i + n])


def register(spark: SparkSession) -> None:
    """damerau, fuzzy_frequency, sequence_similarity, advanced_match and folded_tokens, and the table function ngrams, for spark.sql."""
    def fold(text: pd.Series) -> pd.Series:
        return text.map(fuzzy.folded_tokens)

    spark.udf.register("damerau", fuzzy.damerau_distance)
    spark.udf.register("fuzzy_frequency", fuzzy.fuzzy_frequency)
    spark.udf.register("sequence_similarity", fuzzy.similarity)
    spark.udf.register("advanced_match", fuzzy.advanced_text_match)
    spark.udf.register("folded_tokens", pandas_udf(fold, ArrayType(StringType())))
    spark.udtf.register("ngrams", Ngrams)
