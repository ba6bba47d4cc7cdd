"""Joins that Spark has no direct form for, or that one hot key would stall.

Equality joins need nothing here: adaptive execution splits their skewed
partitions and broadcasts sides that turn out small.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F

from weftline.functions.columns import epoch_micros, same, time_bucket
from weftline.operators.ordered import ROWS_PER_SLICE, order_rows, spread
from weftline.scratch import written


def as_of_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    time: str,
    *,
    ties: Sequence[str] = (),
    tolerance: float | None = None,
    rows_per_slice: int = ROWS_PER_SLICE,
    slices: int | None = None,
) -> DataFrame:
    """Give each left row the latest right row of its keys at or before its time.

    Both sides have the columns ``keys`` and ``time``. The result has every left
    row, then the right side's other columns and its time as ``matched_<time>``;
    they are null where nothing matches or the match is more than ``tolerance``
    seconds old. Right columns in ``ties`` choose among right rows of one time:
    the greatest wins.

    The two sides are united and read in time order once, so there is no pair
    of rows to compare. As in SQL, a null key or time on either side matches nothing.
    """
    values = [c for c in right.columns if c not in (*keys, time)]
    clash = set(values) & set(left.columns)
    if clash:
        raise ValueError(f"rename the right side's {sorted(clash)}")
    match = F.struct(F.col(time).alias(f"matched_{time}"), *values)
    tie_names = [f"_tie_{c}" for c in ties]
    sightings = right.dropna(subset=[*keys, time]).select(
        *keys,
        time,
        F.lit(0).alias("_side"),
        *[F.col(c).alias(n) for c, n in zip(ties, tie_names)],
        match.alias("_match"),
    )
    looking = left.withColumns({"_side": F.lit(1), "_spread": spread(left)})
    rows = looking.unionByName(sightings, allowMissingColumns=True)
    # At one time, right rows (side 0) come before the left rows that see them.
    order = [time, "_side", *tie_names, "_spread"]
    ordered = order_rows(
        rows, keys, order, rows_per_slice=rows_per_slice, slices=slices
    ).with_running(_seen=("last", "_match"))
    seen = F.when(_all_set([*keys, time]), F.col("_seen"))
    if tolerance is not None:
        age = epoch_micros(time) - epoch_micros(seen[f"matched_{time}"])
        seen = F.when(age <= int(tolerance * 1_000_000), seen)
    return (
        ordered.result()
        .where("_side = 1")
        .withColumn("_seen", seen)
        .select(*left.columns, f"_seen.matched_{time}", *[f"_seen.{v}" for v in values])
    )


def interval_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_time: str,
    right_time: str,
    within: float,
) -> DataFrame:
    """Pairs with equal keys whose right time lies in ``[left, left + within]``.

    Time is cut into buckets of the interval's length and each left row looks
    into two of them, so rows further apart never meet and one key's rows
    spread over its buckets. The sides' key columns share names; all other
    column names differ.
    """
    mine = left.withColumn("_first", time_bucket(left_time, within)).withColumn(
        "_bucket", F.explode(F.array(F.col("_first"), F.col("_first") + 1))
    )
    theirs = right.withColumn("_bucket", time_bucket(right_time, within))
    apart = epoch_micros(right_time) - epoch_micros(left_time)
    return (
        mine.drop("_first")
        .join(theirs, [*keys, "_bucket"])
        .where(apart.between(0, int(within * 1_000_000)))
        .drop("_bucket")
    )


def range_join(
    points: DataFrame, ranges: DataFrame, point: str, low: str, high: str, bin_width: float
) -> DataFrame:
    """Pairs where a point lies in the closed range ``[low, high]``.

    Each range is listed under every bin it touches and each point under its
    own, which makes this an equality join on the bin. Choose ``bin_width``
    near the usual length of a range.
    """

    def bin_of(column: str) -> Column:
        return F.floor(F.col(column) / F.lit(float(bin_width)))

    spread = ranges.withColumn("_bin", F.explode(F.sequence(bin_of(low), bin_of(high))))
    return (
        points.withColumn("_bin", bin_of(point))
        .join(spread, "_bin")
        .where(F.col(point).between(F.col(low), F.col(high)))
        .drop("_bin")
    )


def range_join_any(
    points: DataFrame,
    ranges: DataFrame,
    point: str,
    low: str,
    high: str,
    *,
    bits: int = 3,
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """Pairs where a point lies in the closed range ``[low, high]``, for ranges of any widths.

    Points are put in order and each range becomes the run of places that it holds. A tree
    over the places, each node of ``2 ** bits`` of the level below, cuts a run into whole
    nodes: fewer than ``2 ** (bits + 1)`` a level, so a range over all of ``n`` points is some
    ``log(n)`` rows. Each point is listed under its node of every level that some range
    uses. The join is then one of equal nodes, every pair of it is a result, and a node that
    many points share is split as any skewed key is.

    Values are numbers. Nulls and ranges that end before they begin match nothing; rows that
    repeat give a pair each. The sides' columns have different names.
    """
    set_points = points.where(F.col(point).isNotNull())
    total = set_points.count()
    wanted = ranges.where(F.col(low) <= F.col(high))
    below = count_below(wanted, set_points, low, point, "_before", rows_per_slice=rows_per_slice)
    turned = set_points.select((-F.col(point)).alias("_turned"))
    counted = count_below(
        below.withColumn("_high", -F.col(high)), turned, "_high", "_turned", "_beyond", rows_per_slice=rows_per_slice
    )
    runs = counted.select(
        *ranges.columns, F.col("_before").alias("_lo"), (F.lit(total) - F.col("_beyond") - 1).alias("_hi")
    ).where("_lo <= _hi")
    # One level more than the places need: its nodes have nothing above them.
    levels = 0
    while total >> (bits * levels):
        levels += 1
    nodes = f"""flatten(transform(sequence(0, {levels}), l -> transform(
        array_distinct(concat({_span("i(l)", "least(j(l), shiftleft(i(l + 1), {b}) - 1)")},
                              {_span("greatest(i(l), shiftleft(j(l + 1) + 1, {b}))", "j(l)")})),
        n -> struct(l AS _level, n AS _node))))"""
    first = r"shiftright(_lo + shiftleft(1L, {b} * (\1)) - 1, {b} * (\1))"
    last = r"(shiftright(_hi + 1, {b} * (\1)) - 1)"
    for name, form in (("i", first), ("j", last)):
        nodes = re.sub(rf"\b{name}\((l(?: \+ 1)?)\)", form, nodes)
    pieces = runs.withColumn("_n", F.explode(F.expr(nodes.replace("{b}", str(bits))))).select(*ranges.columns, "_n.*")
    pieces = written(pieces, "pieces")
    used = sorted(r[0] for r in pieces.select("_level").distinct().collect())  # a level each
    placed = order_rows(
        set_points.withColumn("_spread", spread(set_points)), [], [point, "_spread"], rows_per_slice=rows_per_slice
    ).with_row_number("_place")
    listed = placed.result().select(
        *points.columns,
        F.explode(
            F.array(
                *[F.struct(F.lit(k).alias("_level"), F.shiftright(F.col("_place") - 1, bits * k).alias("_node")) for k in used or [0]]
            )
        ).alias("_n"),
    )
    return listed.select(*points.columns, "_n.*").join(pieces, ["_level", "_node"]).drop("_level", "_node")


def _span(first: str, last: str) -> str:
    """SQL of the numbers from first to last, none if they are the other way round."""
    return f"CASE WHEN {first} <= {last} THEN sequence({first}, {last}) ELSE CAST(array() AS ARRAY<BIGINT>) END"


def count_below(
    left: DataFrame,
    right: DataFrame,
    left_value: str,
    right_value: str,
    name: str,
    keys: Sequence[str] = (),
    *,
    rows_per_slice: int = ROWS_PER_SLICE,
    slices: int | None = None,
) -> DataFrame:
    """Count, for each left row, the right rows of its keys with a smaller value.

    The inequality join behind that count would emit pairs. A running count
    over both sides in value order reads each row once; the right side is
    grouped by value first. As in SQL, nothing is below null and null keys match nothing.
    """
    marks = (
        right.where(_all_set([*keys, right_value]))
        .groupBy(*keys, F.col(right_value).alias("_value"))
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_side", F.lit(1))
    )
    rows = left.withColumns(
        {"_value": F.col(left_value), "_side": F.lit(0), "_spread": spread(left)}
    )
    # A left row comes before the right rows of its own value: "smaller" only.
    ordered = order_rows(
        rows.unionByName(marks, allowMissingColumns=True),
        keys,
        ["_value", "_side", "_spread"],
        rows_per_slice=rows_per_slice,
        slices=slices,
    ).with_running(_below=("sum", "_n"))
    return (
        ordered.result()
        .where("_side = 0")
        .select(
            *left.columns,
            F.when(_all_set([*keys, left_value]), F.coalesce("_below", F.lit(0)))
            .otherwise(F.lit(0))
            .alias(name),
        )
    )


def full_outer_join(
    left: DataFrame, right: DataFrame, on: Sequence[tuple[str, str]]
) -> DataFrame:
    """A full outer join whose hot keys can be split.

    Adaptive execution splits neither side of a full outer join. It can split a
    left join and an anti join, and together they hold the same rows.
    """
    matched = _equal(left, right, on)
    unmatched = right.join(left.select(*[l for l, _ in on]).distinct(), matched, "left_anti")
    return left.join(right, matched, "left").unionByName(unmatched, allowMissingColumns=True)


def null_safe_join(
    left: DataFrame, right: DataFrame, on: Sequence[tuple[str, str]], how: str = "inner"
) -> DataFrame:
    """An equality join in which null equals null."""
    return left.join(right, same((left[l], right[r]) for l, r in on), how)


def _all_set(columns: Sequence[str]) -> Column:
    return reduce(and_, (F.col(c).isNotNull() for c in columns))


def _equal(left: DataFrame, right: DataFrame, on: Sequence[tuple[str, str]]) -> Column:
    return F.expr(" AND ".join(f"`{l}` = `{r}`" for l, r in on))
