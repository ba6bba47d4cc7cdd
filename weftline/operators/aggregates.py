"""Aggregates that stay bounded when a group holds most of the rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from weftline.functions.columns import same
from weftline.operators.ordered import ROWS_PER_SLICE, order_rows
from weftline.scratch import written


def summed_sets(
    df: DataFrame,
    columns: Sequence[str],
    aggregates: Mapping[str, Column],
    *,
    sets: str | Sequence[Sequence[str]] = "cube",
) -> DataFrame:
    """Sums and counts over a cube, a rollup or a list of grouping sets.

    Spark repeats every input row once per grouping set. Grouping by all the
    columns first means that only the finest groups are repeated, and their
    aggregates, which must be sums or counts, are added up. ``level`` is Spark's
    grouping id.
    """
    finest = df.groupBy(*columns).agg(*[c.alias(n) for n, c in aggregates.items()])
    if sets == "cube":
        grouped = finest.cube(*columns)
    elif sets == "rollup":
        grouped = finest.rollup(*columns)
    else:
        grouped = finest.groupingSets([[F.col(c) for c in s] for s in sets], *columns)
    added = [F.sum(n).alias(n) for n in aggregates]
    return grouped.agg(F.grouping_id().cast("int").alias("level"), *added)


def mode(df: DataFrame, keys: Sequence[str], value: str, name: str = "mode") -> DataFrame:
    """The most frequent value; the smallest one among equals. A group of nulls alone has
    the mode null, found 0 times."""
    counts = df.groupBy(*keys, value).agg(F.count(value).alias("_n"))
    # The least of (-count, value) is the highest count's smallest value.
    best = F.min(F.struct((-F.col("_n")).alias("_minus"), F.col(value).alias("_value")))
    return (
        counts.groupBy(*keys)
        .agg(best.alias("_best"))
        .select(*keys, F.col("_best._value").alias(name), (-F.col("_best._minus")).alias("frequency"))
    )


def quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probabilities: Mapping[str, float],
    *,
    rows_per_slice: int = ROWS_PER_SLICE,
    slices: int | None = None,
) -> DataFrame:
    """Exact, linearly interpolated quantiles of each group.

    Values are counted first, then numbered in order by a running count, and
    the two values around each wanted position are picked out. No task holds a
    group's values, unlike Spark's ``percentile``, which keeps them in a map.
    Nulls do not count; a group of nulls alone has null quantiles.
    """
    counts = written(df.groupBy(*keys, value).agg(F.count(value).alias("_n")), "values")
    totals = counts.groupBy(*keys).agg(F.sum("_n").alias("_total"))
    placed = (
        order_rows(counts, keys, [value], rows_per_slice=rows_per_slice, slices=slices)
        .with_running(_through=("sum", "_n"))
        .result()
    )
    rows = _join_groups(placed, totals, keys)

    def value_at(position: Column) -> Column:
        here = (position < F.col("_through")) & (position >= F.col("_through") - F.col("_n"))
        return F.max(F.when(here, F.col(value)))

    parts, results = [], []
    for name, p in probabilities.items():
        place = F.lit(float(p)) * (F.col("_total") - 1)
        parts += [
            value_at(F.floor(place)).alias(f"_low_{name}"),
            value_at(F.ceil(place)).alias(f"_high_{name}"),
            F.max(place - F.floor(place)).alias(f"_part_{name}"),
        ]
        low, high = F.col(f"_low_{name}"), F.col(f"_high_{name}")
        results.append((low + (high - low) * F.col(f"_part_{name}")).alias(name))
    return rows.groupBy(*keys).agg(*parts).select(*keys, *results)


def value_ranks(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    *,
    rows_per_slice: int = ROWS_PER_SLICE,
    slices: int | None = None,
) -> DataFrame:
    """rank, dense_rank, percent_rank and cume_dist of every row.

    They depend on the counts of distinct values alone, so those are what gets
    ordered, however often a value repeats; rows then join their value's ranks.
    """
    value = order.removesuffix(" desc")
    counts = written(df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n")), "values")
    totals = counts.groupBy(*keys).agg(F.sum("_n").alias("_total"))
    placed = (
        order_rows(counts, keys, [order], rows_per_slice=rows_per_slice, slices=slices)
        .with_row_number("dense_rank")
        .with_running(_through=("sum", "_n"))
        .result()
    )
    placed = _join_groups(placed, totals, keys)
    rank = F.col("_through") - F.col("_n") + 1
    ranks = placed.select(
        *keys,
        value,
        rank.alias("rank"),
        "dense_rank",
        F.when(F.col("_total") == 1, F.lit(0.0))
        .otherwise((rank - 1) / (F.col("_total") - 1))
        .alias("percent_rank"),
        (F.col("_through") / F.col("_total")).alias("cume_dist"),
    )
    return _join_groups(df, ranks, (*keys, value))


def ntile(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    tiles: int,
    name: str = "tile",
    *,
    rows_per_slice: int = ROWS_PER_SLICE,
    slices: int | None = None,
) -> DataFrame:
    """Deal the ordered rows of each group into equal tiles, longer ones first."""
    totals = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_total"))
    rows = (
        order_rows(df, keys, order, rows_per_slice=rows_per_slice, slices=slices)
        .with_row_number("_rn")
        .result()
    )
    rows = _join_groups(rows, totals, keys)
    extra = F.col("_total") % tiles
    short = (F.col("_total") - extra) / tiles
    in_long = extra * (short + 1)
    tile = F.when(F.col("_rn") <= in_long, F.ceil(F.col("_rn") / (short + 1))).otherwise(
        extra + F.ceil(F.try_divide(F.col("_rn") - in_long, short))
    )
    return rows.withColumn(name, tile.cast("int")).select(*df.columns, name)


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[str], k: int) -> DataFrame:
    """The first ``k`` rows of each group. Each task keeps only ``k`` rows of a
    group before the exchange, so a hot group arrives already cut down."""
    sort = [
        F.desc(name.removesuffix(" desc")) if name.endswith(" desc") else F.asc(name)
        for name in order
    ]
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*sort))
    return df.withColumn("place", place).where(F.col("place") <= k)


def with_group_values(df: DataFrame, keys: Sequence[str], **aggregates: Column) -> DataFrame:
    """Add aggregates of the whole group to each of its rows.

    A window over the whole group would collect it in one task. Aggregating
    apart and joining back combines before the exchange and lets the join split.
    """
    totals = df.groupBy(*keys).agg(*[c.alias(n) for n, c in aggregates.items()])
    return _join_groups(df, totals, keys)


def _join_groups(rows: DataFrame, groups: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Join one row per group onto the rows; null keys match.

    The groups are written first. Spark then plans with their true size: below
    its broadcast threshold the rows stay where they are, above it both sides
    are exchanged and a skewed key is split.
    """
    if not keys:  # one row of totals: constants, not a join
        totals = groups.first()
        types = groups.schema
        return rows.withColumns({c: F.lit(totals[c]).cast(types[c].dataType) for c in groups.columns})
    known = written(groups, "groups")
    extra = [c for c in groups.columns if c not in keys]
    named = known.select(*[F.col(k).alias(f"_g_{k}") for k in keys], *extra)
    on = same((rows[k], named[f"_g_{k}"]) for k in keys)
    return rows.join(named, on).drop(*[f"_g_{k}" for k in keys])
