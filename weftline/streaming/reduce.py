"""Reducing the rows of a stream before an exchange."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame


def earliest_per_batch(rows: DataFrame, keys: Sequence[str], time: str) -> DataFrame:
    """Keep the least ``time`` of equal keys within each Arrow batch.

    Streaming deduplication and custom state have no partial step of their own:
    without this, every copy of a hot key would reach the task that holds its
    state. Give ``time`` as a number; set the watermark on the result.
    """
    names = [*keys, time]

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grouped = pa.Table.from_batches([batch]).group_by(list(keys))
            least = grouped.aggregate([(time, "min")])
            yield from least.rename_columns(names).to_batches()

    rows = rows.select(*names)
    return rows.mapInArrow(reduce, rows.schema)
