"""Grouped functions over consecutive blocks of a bounded number of rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from weftline.operators.ordered import ROWS_PER_SLICE, order_rows


def apply_in_blocks(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    size: int,
    function: Callable[[pd.DataFrame], pd.DataFrame],
    schema: StructType | str,
    *,
    rows_per_slice: int = ROWS_PER_SLICE,
    slices: int | None = None,
) -> DataFrame:
    """Cut each group's ordered rows into blocks of ``size`` and apply a pandas
    function to every block.

    The function gets a block's rows in order, with its number in ``block``. A
    group of any size reaches Python in blocks, never as a whole.
    """
    numbered = (
        order_rows(df, keys, order, rows_per_slice=rows_per_slice, slices=slices)
        .with_row_number("_rn")
        .result()
    )
    block = ((F.col("_rn") - 1 - (F.col("_rn") - 1) % size) / size).cast("bigint")

    def call(rows: pd.DataFrame) -> pd.DataFrame:
        return function(rows.sort_values("_rn", ignore_index=True).drop(columns="_rn"))

    return numbered.withColumn("block", block).groupBy(*keys, "block").applyInPandas(call, schema)
