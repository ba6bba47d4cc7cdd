"""Sizes for queries that show an operator's way with large keys."""

from __future__ import annotations

from pyspark.sql import DataFrame

SLICES = 150


def few_rows(df: DataFrame) -> int:
    """Rows a slice so small that usual keys of ``df`` span several, whatever its size."""
    return max(20, df.count() // SLICES)
