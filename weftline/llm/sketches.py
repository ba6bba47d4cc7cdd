"""Summaries of fixed size, made in tasks and merged in Spark."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.textbytes import mix

SLICES = 16


def slices(table: np.ndarray) -> list[tuple[int, bytes]]:
    """A table as packed slices, to be merged slice by slice."""
    return [(k, zlib.compress(part.tobytes(), 1)) for k, part in enumerate(np.split(table, SLICES))]


def merged(rows: DataFrame, dtype: str, merge: Callable, size: int) -> np.ndarray:
    """The table of ``size`` values that the slices (``slice int, packed binary``) give
    under ``merge``. Its size is fixed, so it may come to the driver and be broadcast."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, packed in zip(batch.column("slice").to_pylist(), batch.column("packed").to_pylist()):
                part = np.frombuffer(zlib.decompress(packed), dtype)
                held[k] = merge(held[k], part) if k in held else part
        for k, part in held.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([k], pa.int32()), pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())],
                names=["slice", "packed"],
            )

    parts = rows.repartition(SLICES, "slice").mapInArrow(join, "slice int, packed binary").collect()
    table = np.zeros(size, dtype)
    width = size // SLICES
    for row in parts:
        table[row["slice"] * width : (row["slice"] + 1) * width] = np.frombuffer(
            zlib.decompress(row["packed"]), dtype
        )
    return table


FILTER_BITS = 24


def id_bits(ids: np.ndarray) -> np.ndarray:
    return (mix(ids.astype(np.int64).view(np.uint64)) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def id_filter(ids: DataFrame) -> np.ndarray:
    """A bitmap of fixed size that knows all ids of a one-column table, and some others:
    a first sieve for a scan, before a join that is exact."""
    name = ids.columns[0]

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << FILTER_BITS, bool)
        for batch in batches:
            table[id_bits(batch.column(name).to_numpy(zero_copy_only=False))] = True
        packed = slices(np.packbits(table))
        yield pa.RecordBatch.from_arrays(
            [pa.array([k for k, _ in packed], pa.int32()), pa.array([p for _, p in packed], pa.binary())],
            names=["slice", "packed"],
        )

    partial = ids.where(F.col(name).isNotNull()).mapInArrow(fill, "slice int, packed binary")
    return merged(partial, "uint8", np.bitwise_or, (1 << FILTER_BITS) // 8)


def known(bitmap: np.ndarray, ids: np.ndarray) -> np.ndarray:
    at = id_bits(ids)
    return (bitmap[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
