"""Window queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions.columns import cents, epoch_micros, money, total
from weftline.operators.aggregates import ntile, top_k, value_ranks, with_group_values
from weftline.operators.ordered import order_rows
from weftline.operators.timed import sessions, time_frame, trailing_sums
from weftline.plans.registry import query
from weftline.plans.sizes import few_rows
from weftline.sources.tables import table


def _few(spark, folder) -> int:
    return few_rows(table(spark, folder, "events"))


_ROW_NUMBER = """
SELECT o_orderkey, o_orderpriority,
  row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS rn
FROM orders
"""


def _row_number(spark, folder, **options):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    return (
        order_rows(orders, ["o_orderpriority"], ["o_totalprice desc", "o_orderkey"], **options)
        .with_row_number("rn")
        .result()
        .drop("o_totalprice")
    )


@query(_ROW_NUMBER)
def window_row_number(spark, folder):
    return _row_number(spark, folder)


@query(_ROW_NUMBER)
def window_row_number_sliced(spark, folder):
    return _row_number(spark, folder, rows_per_slice=_few(spark, folder))


@query("""
SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS rn,
  sum(o_totalprice::DECIMAL(12,2)) OVER (ORDER BY o_totalprice, o_orderkey)::DOUBLE AS running_price
FROM orders
""")
def window_global_running(spark, folder):
    """No partition key at all: the whole table is one ordered group."""
    orders = table(spark, folder, "orders").select(
        "o_orderkey", "o_totalprice", money("o_totalprice").alias("price")
    )
    return (
        order_rows(orders, [], ["o_totalprice", "o_orderkey"])
        .with_row_number("rn")
        .with_running(running_price=("sum", "price"))
        .result()
        .select("o_orderkey", "rn", F.col("running_price").cast("double"))
    )


_RANKS = """
SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag, l_quantity,
  rank() OVER w AS "rank", dense_rank() OVER w AS "dense_rank",
  percent_rank() OVER w AS "percent_rank", cume_dist() OVER w AS "cume_dist"
FROM lineitem WINDOW w AS (PARTITION BY l_returnflag ORDER BY l_quantity DESC)
"""


@query(_RANKS)
def window_ranks(spark, folder):
    lines = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_quantity"
    )
    return value_ranks(lines, ["l_returnflag"], "l_quantity desc")


@query("""
SELECT o_orderkey, o_orderpriority,
  ntile(7) OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice, o_orderkey)::INTEGER AS tile
FROM orders
""")
def window_ntile(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    return ntile(orders, ["o_orderpriority"], ["o_totalprice", "o_orderkey"], 7).drop("o_totalprice")


_LAG_LEAD = """
SELECT event_id, event_type, lag(value) OVER w AS previous, lead(value, 2) OVER w AS later,
  round(epoch(ts - lag(ts) OVER w) * 1000000)::BIGINT AS micros_since
FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)
"""


def _lag_lead(spark, folder, **options):
    events = table(spark, folder, "events").select("event_id", "event_type", "ts", "value")
    return (
        order_rows(events, ["event_type"], ["ts", "event_id"], **options)
        .with_shifted(previous=("value", -1), later=("value", 2), before_ts=("ts", -1))
        .with_columns(micros_since=epoch_micros("ts") - epoch_micros("before_ts"))
        .result()
        .drop("ts", "value", "before_ts")
    )


@query(_LAG_LEAD)
def window_lag_lead(spark, folder):
    return _lag_lead(spark, folder)


@query(_LAG_LEAD)
def window_lag_lead_sliced(spark, folder):
    return _lag_lead(spark, folder, rows_per_slice=_few(spark, folder))


_RUNNING = """
SELECT event_id, event_type,
  sum(value::DECIMAL(12,2)) OVER w::DOUBLE AS running_value, count(*) OVER w AS running_n,
  max(value) OVER w AS highest, min(value) OVER w AS lowest
FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id
                         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
"""


def _running(spark, folder, **options):
    events = table(spark, folder, "events").select(
        "event_id", "event_type", "ts", "value", money("value").alias("amount")
    )
    return (
        order_rows(events, ["event_type"], ["ts", "event_id"], **options)
        .with_running(
            running_value=("sum", "amount"),
            running_n=("count", "event_id"),
            highest=("max", "value"),
            lowest=("min", "value"),
        )
        .result()
        .withColumn("running_value", F.col("running_value").cast("double"))
        .drop("ts", "value", "amount")
    )


@query(_RUNNING)
def window_running(spark, folder):
    return _running(spark, folder)


@query(_RUNNING)
def window_running_sliced(spark, folder):
    return _running(spark, folder, rows_per_slice=_few(spark, folder))


@query("""
SELECT event_id, user_id,
  sum(value::DECIMAL(12,2)) OVER w::DOUBLE AS moving_sum, count(*) OVER w AS moving_n,
  max(value) OVER w AS moving_max
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id
                         ROWS BETWEEN 5 PRECEDING AND 2 FOLLOWING)
""")
def window_moving_rows(spark, folder):
    events = table(spark, folder, "events").select(
        "event_id", "user_id", "ts", "value", money("value").alias("amount")
    )
    return (
        order_rows(events, ["user_id"], ["ts", "event_id"])
        .with_frame(
            before=5,
            after=2,
            moving_sum=F.sum("amount"),
            moving_n=F.count(F.lit(1)),
            moving_max=F.max("value"),
        )
        .result()
        .withColumn("moving_sum", F.col("moving_sum").cast("double"))
        .drop("ts", "value", "amount")
    )


_TIME_RANGE = """
SELECT event_id, {key}, count(*) OVER w AS recent_n,
  sum(value::DECIMAL(12,2)) OVER w::DOUBLE AS recent_value
FROM events WINDOW w AS (PARTITION BY {key} ORDER BY ts
                         RANGE BETWEEN INTERVAL 6 HOUR PRECEDING AND CURRENT ROW)
"""


@query(_TIME_RANGE.format(key="user_id"))
def window_time_range(spark, folder):
    events = table(spark, folder, "events").select(
        "event_id", "user_id", "ts", money("value").alias("amount")
    )
    return (
        time_frame(
            events, ["user_id"], "ts", 6 * 3600, bucket=24 * 3600,
            recent_n=lambda w: F.count(F.lit(1)).over(w),
            recent_value=lambda w: F.sum("amount").over(w),
        )
        .withColumn("recent_value", F.col("recent_value").cast("double"))
        .drop("ts", "amount")
    )


def _trailing(spark, folder, **options):
    events = table(spark, folder, "events").select(
        "event_id", "event_type", "ts", cents("value").alias("amount"), F.lit(1).alias("one")
    )
    return (
        trailing_sums(
            events, ["event_type"], "ts", 6 * 3600, recent_n="one", recent_cents="amount", **options
        )
        .withColumn("recent_value", F.col("recent_cents") / 100)
        .select("event_id", "event_type", "recent_n", "recent_value")
    )


@query(_TIME_RANGE.format(key="event_type"))
def window_trailing_sums(spark, folder):
    """A frame of hundreds of rows, without visiting them for every row."""
    return _trailing(spark, folder)


@query(_TIME_RANGE.format(key="event_type"))
def window_trailing_sums_sliced(spark, folder):
    return _trailing(spark, folder, rows_per_slice=_few(spark, folder))


@query("""
SELECT DISTINCT user_id, first_value(event_id) OVER w AS first_event,
  last_value(event_id) OVER w AS last_event, nth_value(event_id, 3) OVER w AS third_event
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id
                         ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
""")
def window_first_last_nth(spark, folder):
    events = table(spark, folder, "events").select("user_id", "ts", "event_id")
    place = F.struct("ts", "event_id")
    third = top_k(events, ["user_id"], ["ts", "event_id"], 3).where("place = 3")
    ends = events.groupBy("user_id").agg(
        F.min_by("event_id", place).alias("first_event"),
        F.max_by("event_id", place).alias("last_event"),
    )
    named = third.select(F.col("user_id").alias("third_user"), F.col("event_id").alias("third_event"))
    return ends.join(named, F.col("user_id").eqNullSafe(F.col("third_user")), "left").drop("third_user")


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
  l_extendedprice / sum(l_extendedprice::DECIMAL(12,2)) OVER (PARTITION BY l_suppkey)::DOUBLE AS share,
  count(*) OVER (PARTITION BY l_suppkey) AS supplier_lines
FROM lineitem
""")
def window_share_of_group(spark, folder):
    lines = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"
    )
    return (
        with_group_values(
            lines,
            ["l_suppkey"],
            whole=total(cents("l_extendedprice"), 2),
            supplier_lines=F.count(F.lit(1)),
        )
        .withColumn("share", F.col("l_extendedprice") / F.col("whole"))
        .drop("whole")
    )


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def top_k_global(spark, folder):
    return (
        table(spark, folder, "orders")
        .select("o_orderkey", "o_totalprice")
        .orderBy(F.desc("o_totalprice"), "o_orderkey")
        .limit(25)
    )


@query("""
SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey
LIMIT 25 OFFSET 50
""")
def top_k_offset(spark, folder):
    return (
        table(spark, folder, "orders")
        .select("o_orderkey", "o_totalprice")
        .orderBy(F.desc("o_totalprice"), "o_orderkey")
        .offset(50)
        .limit(25)
    )


@query("""
SELECT o_orderkey, o_orderpriority, o_totalprice, place FROM (
  SELECT *, row_number() OVER (PARTITION BY o_orderpriority
                               ORDER BY o_totalprice DESC, o_orderkey)::INTEGER AS place
  FROM orders) WHERE place <= 10
""")
def top_k_per_group(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    return top_k(orders, ["o_orderpriority"], ["o_totalprice desc", "o_orderkey"], 10)


_SESSIONS = """
WITH flagged AS (
  SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS starts
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
numbered AS (
  SELECT *, sum(starts) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS session
  FROM flagged)
SELECT user_id, session, min(ts) AS started, max(ts) AS ended, count(*) AS n,
       sum(value::DECIMAL(12,2))::DOUBLE AS value
FROM numbered GROUP BY user_id, session
"""


def _sessions(spark, folder, **options):
    events = table(spark, folder, "events").select("event_id", "user_id", "ts", "value")
    return (
        sessions(events, ["user_id"], "ts", 3600, tie="event_id", **options)
        .groupBy("user_id", "session")
        .agg(
            F.min("ts").alias("started"),
            F.max("ts").alias("ended"),
            F.count(F.lit(1)).alias("n"),
            total(cents("value"), 2).alias("value"),
        )
    )


@query(_SESSIONS)
def sessions_numbered(spark, folder):
    return _sessions(spark, folder)


@query(_SESSIONS)
def sessions_numbered_sliced(spark, folder):
    return _sessions(spark, folder, rows_per_slice=_few(spark, folder))


@query("""
WITH flagged AS (
  SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS starts
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
numbered AS (
  SELECT *, sum(starts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM flagged)
SELECT user_id, min(ts) AS started, max(ts) + INTERVAL 1 HOUR AS closes, count(*) AS n
FROM numbered GROUP BY user_id, session
""")
def sessions_window(spark, folder):
    """Spark's own session window; rows merge into sessions before the exchange."""
    return (
        table(spark, folder, "events")
        .groupBy("user_id", F.session_window("ts", "1 hour").alias("s"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select("user_id", F.col("s.start").alias("started"), F.col("s.end").alias("closes"), "n")
    )


@query("""
SELECT event_type, date_trunc('hour', ts) AS started, count(*) AS n,
       sum(value::DECIMAL(12,2))::DOUBLE AS value
FROM events GROUP BY ALL
""")
def window_tumbling(spark, folder):
    return (
        table(spark, folder, "events")
        .groupBy("event_type", F.window("ts", "1 hour").alias("w"))
        .agg(F.count(F.lit(1)).alias("n"), total(cents("value"), 2).alias("value"))
        .select("event_type", F.col("w.start").alias("started"), "n", "value")
    )


@query("""
SELECT event_type, date_trunc('hour', ts) - to_hours(back) AS started, count(*) AS n
FROM events, (SELECT unnest([0, 1, 2]) AS back) GROUP BY ALL
""")
def window_sliding(spark, folder):
    """Three-hour windows every hour: counted per hour, then spread to windows."""
    hourly = (
        table(spark, folder, "events")
        .groupBy("event_type", F.window("ts", "1 hour").alias("w"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select("event_type", F.col("w.start").alias("hour"), "n")
    )
    return (
        hourly.groupBy("event_type", F.window("hour", "3 hours", "1 hour").alias("w"))
        .agg(F.sum("n").alias("n"))
        .select("event_type", F.col("w.start").alias("started"), "n")
    )
