"""Sessions and time-range frames over keyed events."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from weftline.functions.columns import epoch_micros, time_bucket
from weftline.operators.ordered import ROWS_PER_SLICE, order_rows, spread


def sessions(
    df: DataFrame,
    keys: Sequence[str],
    time: str,
    gap: float,
    *,
    tie: str,
    rows_per_slice: int = ROWS_PER_SLICE,
    slices: int | None = None,
) -> DataFrame:
    """Number the sessions of each key: a new one starts when ``gap`` seconds or
    more have passed since the key's last row.

    Returns the rows with ``session``, counting from 1. A later ``groupBy`` on
    keys and session needs no further exchange while keys are small. ``tie``
    orders rows of equal time.
    """
    ordered = order_rows(
        df, keys, [time, tie], rows_per_slice=rows_per_slice, slices=slices
    ).with_shifted(_previous=(time, -1))
    quiet = epoch_micros(time) - epoch_micros("_previous")
    starts = F.when(F.col("_previous").isNull() | (quiet >= int(gap * 1_000_000)), 1).otherwise(0)
    return (
        ordered.with_columns(_starts=starts.cast("bigint"))
        .with_running(session=("sum", "_starts"))
        .result()
        .drop("_previous", "_starts")
    )


def time_frame(
    df: DataFrame,
    keys: Sequence[str],
    time: str,
    preceding: float,
    *,
    bucket: float | None = None,
    **outputs: Callable[[WindowSpec], Column],
) -> DataFrame:
    """Window expressions over the rows of the last ``preceding`` seconds.

    Rows are grouped by key and time bucket, and each is also lent to the
    buckets its frame reach extends into, so a key's rows spread over its
    buckets with one exchange. Wider buckets lend fewer rows; narrower ones
    make smaller groups. Every row visits the rows of its frame: for sums over
    dense frames use ``trailing_sums``. Rows without a time see each other, as in SQL.
    """
    bucket = bucket or preceding
    micros = "_micros"
    home = time_bucket(time, bucket)
    span = F.make_dt_interval(secs=F.lit(float(preceding)))
    last = time_bucket(F.col(time) + span, bucket)
    lent = df.withColumns({micros: epoch_micros(time), "_home": home}).withColumn(
        "_bucket", F.explode_outer(F.sequence(F.col("_home"), last))
    )
    frame = (
        Window.partitionBy(*keys, "_bucket")
        .orderBy(micros)
        .rangeBetween(-int(preceding * 1_000_000), Window.currentRow)
    )
    return (
        lent.withColumns({n: make(frame) for n, make in outputs.items()})
        .where("_bucket <=> _home")
        .drop(micros, "_home", "_bucket")
    )


def trailing_sums(
    df: DataFrame,
    keys: Sequence[str],
    time: str,
    preceding: float,
    *,
    rows_per_slice: int = ROWS_PER_SLICE,
    slices: int | None = None,
    **sums: str,
) -> DataFrame:
    """Sums over the rows of the last ``preceding`` seconds, ties included.

    Every value is added at its time and taken away once it is out of reach, so
    a running sum of these changes is the answer. Work does not grow with the
    rows in a frame, and a key of any density splits into slices. Each output
    is ``name=column``; columns must be integers or decimals, which lose
    nothing when taken away again. As in SQL a frame of nulls alone sums to null, and
    rows without a time see each other.
    """
    kinds = dict(df.dtypes)
    for column in sums.values():
        if not kinds[column].startswith(("tinyint", "smallint", "int", "bigint", "decimal")):
            raise ValueError(f"{column} is {kinds[column]}; sum integers or decimals")
    reach = int(preceding * 1_000_000) + 1
    values = {f"_change_{name}": F.col(column) for name, column in sums.items()}
    values |= {f"_seen_{name}": F.col(column).isNotNull().cast("bigint") for name, column in sums.items()}
    named = [c.alias(n) for n, c in values.items()]
    at = df.select(*keys, epoch_micros(time).alias("_micros"), *named)
    # One row comes in and one goes out; equal times of a key become one change.
    change = F.explode(
        F.array(
            F.struct(F.col("_micros").alias("_at"), *values),
            F.struct(
                F.coalesce(F.col("_micros") + reach, F.lit(-(1 << 62))).alias("_at"), *[(-F.col(n)).alias(n) for n in values]
            ),
        )
    )
    changes = (
        at.select(*keys, change.alias("_c"))
        .groupBy(*keys, F.col("_c._at").alias("_micros"))
        .agg(*[F.sum(f"_c.{n}").alias(n) for n in values])
        .withColumn("_side", F.lit(0))
    )
    rows = df.withColumns(
        {"_micros": epoch_micros(time), "_side": F.lit(1), "_spread": spread(df)}
    )
    # At one time the change comes first, so that rows see it whole.
    ordered = order_rows(
        rows.unionByName(changes, allowMissingColumns=True),
        keys,
        ["_micros", "_side", "_spread"],
        rows_per_slice=rows_per_slice,
        slices=slices,
    ).with_running(
        **{name: ("sum", f"_change_{name}") for name in sums},
        **{f"_any_{name}": ("sum", f"_seen_{name}") for name in sums},
    )
    found = [F.when(F.col(f"_any_{name}") > 0, F.col(name)).alias(name) for name in sums]
    return ordered.result().where("_side = 1").select(*df.columns, *found)
