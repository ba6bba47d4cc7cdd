"""Python functions over Arrow batches, for what built-in functions lack."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T


@F.pandas_udf(T.IntegerType())
def luhn_digit(numbers: pd.Series) -> pd.Series:
    """The Luhn check digit of each number; null for null and for negative ones."""
    valid = numbers.notna() & (numbers.fillna(0) >= 0)
    rest = numbers.where(valid, 0).to_numpy(dtype=np.int64, copy=True)
    total = np.zeros_like(rest)
    doubled = True
    while (rest > 0).any():
        digit = rest % 10
        if doubled:
            digit = digit * 2
            digit = np.where(digit > 9, digit - 9, digit)
        total += digit
        rest //= 10
        doubled = not doubled
    return pd.Series(-total % 10, dtype="Int32").where(valid.reset_index(drop=True))


@F.arrow_udf(T.StringType())
def capitalized(words: pa.Array) -> pa.Array:
    """First letter upper case, the rest lower case."""
    return pc.utf8_capitalize(words)


_WORDS = T.StructType([T.StructField("word", T.StringType()), T.StructField("place", T.IntegerType())])


@F.udtf(returnType=_WORDS)
class WordsOf:
    """The words of a text with their places, as a table function."""

    def eval(self, text: str):
        for place, word in enumerate((text or "").split(), start=1):
            yield word, place


def elementwise_max(df: DataFrame, key: str, vector: str) -> DataFrame:
    """The largest value at each place of the vectors of a key; nulls do not count, and a
    null key is a key.

    A grouped Python aggregate would load a whole group into one task. Here
    every Arrow batch is reduced to one partial vector per key, and a built-in
    aggregate merges the partial results.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            rows = pc.list_parent_indices(lists)
            values = pc.list_flatten(lists)
            at = rows.to_numpy().astype(np.int64)
            heads = np.searchsorted(at, at, side="left")
            flat = pa.table(
                {
                    key: batch.column(0).take(rows),
                    "place": pa.array(np.arange(len(at)) - heads, pa.int32()),
                    "x": values,
                }
            )
            best = flat.group_by([key, "place"]).aggregate([("x", "max")])
            yield from best.select([key, "place", "x_max"]).rename_columns([key, "place", "x"]).to_batches()

    rows = df.select(key, F.col(vector).cast("array<double>").alias(vector))
    kind = df.schema[key].dataType.simpleString()
    return (
        rows.mapInArrow(partial, f"`{key}` {kind}, place int, x double")
        .groupBy(key, "place")
        .agg(F.max("x").alias("highest"))
    )
