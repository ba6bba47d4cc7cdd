"""Shards cut along a Hilbert curve over document metadata.

Every dimension is quantised by its own quantiles, the cell numbers become one
position on a Hilbert curve, and the rows, ordered along the curve, are cut into
runs. Neighbours on the curve are close in every dimension, so each shard (and
each file written from it) spans a narrow range of all of them and a reader that
filters by any one dimension skips most files.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.llm.registry import query
from weftline.operators.ordered import order_rows
from weftline.scratch import written
from weftline.sources.tables import table

ORDER = ("_curve", "_group", "_id")


def string_edges(values: DataFrame, cells: int) -> list[str]:
    """At most ``cells - 1`` values that cut the rows of a one-column table of strings into
    cells of about equal size, by whole strings: a cell ends with its edge.

    Distinct values are counted and put in order; those edges alone come to the driver.
    """
    name = values.columns[0]
    counts = values.where(F.col(name).isNotNull()).groupBy(name).agg(F.count("*").alias("_n"))
    counts = written(counts, "values")
    total = counts.agg(F.sum("_n")).first()[0] or 0
    running = order_rows(counts, keys=[], order=[name]).with_running(_upto=("sum", "_n")).result()
    # The last value in each cell of the running count.
    ends = F.floor(F.col("_upto") * cells / F.lit(max(total, 1))) > F.floor((F.col("_upto") - F.col("_n")) * cells / F.lit(max(total, 1)))
    return sorted(r[0] for r in running.where(ends & (F.col("_upto") < total)).select(name).collect())


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Positions on the Hilbert curve of integer points, one point a row.

    ``cells`` has one column a dimension, each below ``2 ** bits``; columns times
    bits must stay below 63. Walking the bits from the top, each step swaps or
    inverts the lower bits so that every sub-cube is entered where the last was left.
    """
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    for level in range(bits - 1, 0, -1):
        high = np.int64(1) << level
        low = high - 1
        for d in range(dims):
            inverted = (x[d] & high) != 0
            swap = np.where(inverted, 0, (x[0] ^ x[d]) & low)
            x[0] = np.where(inverted, x[0] ^ low, x[0] ^ swap)
            if d:
                x[d] ^= swap
    for d in range(1, dims):
        x[d] ^= x[d - 1]
    flip = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        high = np.int64(1) << level
        flip ^= np.where((x[-1] & high) != 0, high - 1, 0)
    x ^= flip
    index = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for d in range(dims):
            index = (index << 1) | ((x[d] >> level) & 1)
    return index


def hilbert_shards(
    rows: DataFrame,
    dimensions: Mapping[str, Column],
    size: Column,
    shards: int,
    *,
    row_id: Column,
    group: Column,
    bits: int = 5,
    group_share: float = 0.05,
) -> DataFrame:
    """Add ``shard`` (int) and ``slot`` (long, from 0 in each shard) to all rows.

    Shards are runs along the curve of near-equal total ``size``: a row goes where
    its midpoint falls. Rows of one ``group`` lie side by side and stay in one shard
    while the group is below ``group_share`` of a shard; larger groups are cut like
    any other run. A small group lies where its member of the smallest id would.
    ``dimensions`` are numeric or string columns; nulls take the lowest cell.

    Ties in curve, group and id are broken by nothing visible: such rows are equal
    in all that the result shows but for columns outside ``dimensions``. Repeated
    rows get a slot each. No rows in, no rows out. A column of the input named like
    an output is replaced.

    The rows are range-partitioned by curve, group and id, so a hot cell is spread
    over tasks, and written once; running sums need one total a partition.
    """
    spark = rows.sparkSession
    inner = {f"_d{i}": column for i, column in enumerate(dimensions.values())}
    placed = rows.drop("shard", "slot", "curve").withColumns(
        {**inner, "_size": size.cast("long"), "_id": row_id, "_group": group}
    )
    # Strings become the number of edges below them: 2 ** bits - 1 numbers or strings a
    # dimension, whatever the size of the table.
    texts = {c: string_edges(placed.select(c), 2**bits) for c, kind in placed.select(*inner).dtypes if kind == "string"}
    numbers = [c for c in inner if c not in texts]
    placed = placed.withColumns({c: F.col(c).cast("double") for c in numbers})
    cuts = placed.agg(
        F.lit(0).alias("_none"), *[F.percentile_approx(c, [k / 2**bits for k in range(1, 2**bits)], 1000).alias(c) for c in numbers]
    ).first()
    edges = {c: sorted(set(cuts[c] or [])) for c in numbers}
    names = tuple(inner)

    def cell(c: str) -> Column:
        if c in edges:
            return F.col(c)
        below = F.filter(F.array(*map(F.lit, texts[c])).cast("array<string>"), lambda edge: edge < F.col(c))
        return F.coalesce(F.size(below), F.lit(0)).cast("double")

    @F.pandas_udf("long")
    def curve(columns: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for parts in columns:
            parts = parts if isinstance(parts, tuple) else (parts,)  # one dimension comes bare
            values = (p.to_numpy(dtype="float64", na_value=np.nan) for p in parts)
            cells = [
                np.where(np.isnan(v), 0, np.searchsorted(np.array(edges[c]), v, side="left") if c in edges else v).astype(np.int64)
                for c, v in zip(names, values)
            ]
            yield pd.Series(hilbert_index(np.stack(cells, axis=1), bits))

    placed = placed.withColumn("_curve", curve(*map(cell, inner))).drop(*inner)
    placed = written(placed, "placed")
    # Equal rows belong together wherever their other columns would put them.
    groups = placed.groupBy("_group").agg(
        F.min(F.struct(F.col("_id").isNull().alias("none"), "_id", "_curve")).alias("_first"), F.count("*").alias("_many")
    )
    lead = written(
        groups.where("_many > 1").select(F.col("_group").alias("_of"), F.col("_first._curve").alias("_at")), "groups"
    )
    placed = placed.join(lead, placed["_group"].eqNullSafe(lead["_of"]), "left")
    placed = placed.withColumn("_curve", F.coalesce("_at", "_curve")).drop("_of", "_at")
    ordered = placed.repartitionByRange(*ORDER).withColumn("_part", F.spark_partition_id())
    ordered = written(ordered, "hilbert")

    totals = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # One row a partition.
    parts = (
        ordered.groupBy("_part")
        .agg(F.count("*").alias("_n"), F.sum("_size").alias("_bytes"))
        .coalesce(1)
        .withColumn("_rows_before", F.coalesce(F.sum("_n").over(totals), F.lit(0)))
        .withColumn("_bytes_before", F.coalesce(F.sum("_bytes").over(totals), F.lit(0)))
        .drop("_n", "_bytes")
    )
    total = ordered.agg(F.sum("_size")).first()[0] or 1
    line = Window.partitionBy("_part").orderBy(*ORDER)
    summed = (
        ordered.join(F.broadcast(parts), "_part")
        .withColumn("_row", F.row_number().over(line) + F.col("_rows_before"))
        .withColumn("_end", F.sum("_size").over(line.rowsBetween(Window.unboundedPreceding, 0)) + F.col("_bytes_before"))
        .withColumn("_start", F.col("_end") - F.col("_size"))
    )
    # A small group moves as one; its extent may cross a partition's edge.
    extent = (
        summed.groupBy("_curve", "_group")
        .agg(F.min("_start").alias("_from"), F.max("_end").alias("_to"), F.count("*").alias("_members"))
        .where((F.col("_members") > 1) & (F.col("_to") - F.col("_from") <= group_share * total / shards))
        .drop("_members")
    )
    middle = (F.coalesce("_from", "_start") + F.coalesce("_to", "_end")) / 2
    cut = (
        summed.join(extent, ["_curve", "_group"], "left")
        .withColumn("shard", F.least(F.lit(shards - 1), F.floor(middle * shards / total)).cast("int"))
    )
    cut = written(cut, "hilbert-cut")
    first = cut.groupBy("shard").agg(F.min("_row").alias("_first"))  # one row a shard
    result = cut.join(F.broadcast(first), "shard").withColumn("slot", F.col("_row") - F.col("_first"))
    added = {"_size", "_id", "_group", "_curve", "_part", "_rows_before", "_bytes_before", "_row", "_end", "_start", "_from", "_to", "_first"}
    return result.select(*[c for c in result.columns if c not in added], F.col("_curve").alias("curve"))


SHARDS = 16


@query()
def op9_hilbert_shards(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in 16 shards of near-equal bytes along a Hilbert curve over
    language, source and length. A null text counts as empty."""
    text = F.coalesce("text", F.lit(""))
    facts = table(spark, folder, "documents").select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.col("lang").alias("_lang"),
        F.col("source").alias("_source"),
        F.xxhash64(text).alias("_text"),
    )
    placed = hilbert_shards(
        facts,
        {"lang": F.col("_lang"), "source": F.col("_source"), "length": F.col("size")},
        F.col("size"),
        SHARDS,
        row_id=F.col("doc_id"),
        group=F.col("_text"),
    )
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
