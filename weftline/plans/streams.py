"""Streaming queries, run over everything their source holds.

Append mode emits a window once the watermark has passed its end; a row at the end of
time closes the last ones, so the results are those of the whole table. A row later
than the watermark's delay is dropped, as in any stream.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import functions as F

from weftline.functions.columns import cents, exact_sum, time_bucket, total
from weftline.plans.registry import query
from weftline.sources.tables import table
from weftline.streaming.milestones import completions
from weftline.streaming.reduce import earliest_per_batch
from weftline.streaming.runs import Closing, replay, run_to_end, run_to_partials, run_to_table, table_stream

EVENTS_PER_BATCH = 20_000_000
EVENTS_PER_BUCKET = 20_000


def _events(spark, folder):
    return table_stream(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _ending(spark, folder):
    return Closing(_events(spark, folder), "ts")


def _replayed(spark, folder, *columns):
    """These columns of the events as several files in the order of time, one a micro-batch."""
    events = table(spark, folder, "events").select(*columns)
    return replay(events, _batches(events), "ts").withColumn("ts", F.col("ts").cast("timestamp"))


def _batches(events):
    return min(64, max(3, ceil(events.count() / EVENTS_PER_BATCH)))


def _ntz(column):
    return F.col(column).cast("timestamp_ntz")


@query("""
WITH counted AS (
  SELECT date_trunc('hour', ts) AS started, event_type, count(*) AS n,
         sum(value::DECIMAL(12,2))::DOUBLE AS value
  FROM events GROUP BY 1, 2)
SELECT * FROM counted
""")
def stream_tumbling(spark, folder):
    closing = _ending(spark, folder)
    counted = (
        closing.stream.withWatermark("ts", "10 minutes")
        .groupBy(F.window("ts", "1 hour").alias("w"), "event_type")
        .agg(F.count(F.lit(1)).alias("n"), total(cents("value"), 2).alias("value"))
        .select("w.start", "event_type", "n", "value")
    )
    return run_to_table(counted, closing).select(_ntz("start").alias("started"), "event_type", "n", "value")


@query("""
WITH counted AS (
  SELECT date_trunc('hour', ts) - to_hours(back) AS started, event_type, count(*) AS n
  FROM events, (SELECT unnest([0, 1, 2]) AS back) GROUP BY 1, 2)
SELECT * FROM counted
""")
def stream_sliding(spark, folder):
    closing = _ending(spark, folder)
    counted = (
        closing.stream.withWatermark("ts", "10 minutes")
        .groupBy(F.window("ts", "3 hours", "1 hour").alias("w"), "event_type")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("w.start", "event_type", "n")
    )
    return run_to_table(counted, closing).select(_ntz("start").alias("started"), "event_type", "n")


@query("""
WITH flagged AS (
  SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS starts
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
numbered AS (
  SELECT *, sum(starts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM flagged)
SELECT user_id, min(ts) AS started, max(ts) + INTERVAL 1 HOUR AS closes, count(*) AS n
FROM numbered GROUP BY user_id, session
""")
def stream_sessions(spark, folder):
    closing = _ending(spark, folder)
    merged = (
        closing.stream.withWatermark("ts", "10 minutes")
        .groupBy("user_id", F.session_window("ts", "1 hour").alias("s"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select("user_id", "s.start", "s.end", "n")
    )
    return run_to_table(merged, closing).select(
        "user_id", _ntz("start").alias("started"), _ntz("end").alias("closes"), "n"
    )


@query("SELECT DISTINCT user_id, event_type, date_trunc('hour', ts) AS hour FROM events")
def stream_distinct(spark, folder):
    """The hour is the event time, so that old keys leave the state."""
    hours = _events(spark, folder).select(
        "user_id", "event_type", F.unix_micros(F.date_trunc("hour", "ts")).alias("micros")
    )
    copies = hours.withColumn("seen", F.col("micros"))
    kept = (
        earliest_per_batch(copies, ["user_id", "event_type", "micros"], "seen")
        .withColumn("hour", F.timestamp_micros("micros"))
        .withWatermark("hour", "2 hours")
        .dropDuplicates(["user_id", "event_type", "hour"])
    )
    return run_to_table(kept.select("user_id", "event_type", "hour")).select(
        "user_id", "event_type", _ntz("hour").alias("hour")
    )


@query("SELECT DISTINCT props AS key FROM events")
def stream_distinct_within_watermark(spark, folder):
    """With a delay longer than the stream, every later copy counts as one."""
    keys = _events(spark, folder).select(
        F.col("props").alias("key"), F.unix_micros("ts").alias("micros")
    )
    kept = (
        earliest_per_batch(keys, ["key"], "micros")
        .withColumn("ts", F.timestamp_micros("micros"))
        .withWatermark("ts", "400 days")
        .dropDuplicatesWithinWatermark(["key"])
    )
    return run_to_table(kept.select("key"))


@query("""
SELECT a.event_id AS view_id, b.event_id AS purchase_id, a.user_id
FROM events a JOIN events b ON a.user_id = b.user_id
WHERE a.event_type = 'view' AND b.event_type = 'purchase'
  AND b.ts BETWEEN a.ts AND a.ts + INTERVAL 1 HOUR
""")
def stream_interval_join(spark, folder):
    """Buckets of an hour spread a user's state; the time bounds let it expire."""
    events = _events(spark, folder)
    hour = time_bucket(_ntz("ts"), 3600)
    views = (
        events.where("event_type = 'view'")
        .select(F.col("event_id").alias("view_id"), "user_id", F.col("ts").alias("view_ts"), hour.alias("h"))
        .withWatermark("view_ts", "1 hour")
        .withColumn("bucket", F.explode(F.array(F.col("h"), F.col("h") + 1)))
    )
    purchases = (
        events.where("event_type = 'purchase'")
        .select(
            F.col("event_id").alias("purchase_id"),
            F.col("user_id").alias("buyer"),
            F.col("ts").alias("purchase_ts"),
            hour.alias("purchase_bucket"),
        )
        .withWatermark("purchase_ts", "1 hour")
    )
    near = F.expr("""
        user_id = buyer AND bucket = purchase_bucket
        AND purchase_ts >= view_ts AND purchase_ts <= view_ts + INTERVAL 1 HOUR""")
    return run_to_table(views.join(purchases, near).select("view_id", "purchase_id", "user_id"))


@query("""
SELECT event_id, event_type, c_mktsegment, n_name
FROM events JOIN customer ON user_id = c_custkey JOIN nation ON c_nationkey = n_nationkey
WHERE event_type IN ('purchase', 'signup')
""")
def stream_static_join(spark, folder):
    people = (
        table(spark, folder, "customer")
        .join(table(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .select("c_custkey", "c_mktsegment", "n_name")
    )
    wanted = table_stream(spark, folder, "events").where("event_type IN ('purchase', 'signup')")
    joined = wanted.join(people, F.col("user_id") == F.col("c_custkey"))
    return run_to_table(joined.select("event_id", "event_type", "c_mktsegment", "n_name"))


@query("""
SELECT user_id, count(*) AS n, sum(value::DECIMAL(12,2))::DOUBLE AS value, max(ts) AS latest
FROM events GROUP BY user_id
""")
def stream_partial_totals(spark, folder):
    """Several micro-batches leave partial totals that a reader merges."""
    events = table(spark, folder, "events").select("user_id", "ts", "value")

    def summarise(batch):
        return batch.groupBy("user_id").agg(
            F.count(F.lit(1)).alias("n"), exact_sum(cents("value"), 2).alias("value"), F.max("ts").alias("latest")
        )

    return (
        run_to_partials(replay(events, _batches(events), "ts"), summarise)
        .groupBy("user_id")
        .agg(F.sum("n").alias("n"), F.sum("value").cast("double").alias("value"), F.max("latest").alias("latest"))
    )


@query("""
SELECT user_id, max(first_ts) AS completed FROM (
  SELECT user_id, event_type, min(ts) AS first_ts FROM events
  WHERE event_type IN ('view', 'click', 'purchase') GROUP BY user_id, event_type)
GROUP BY user_id HAVING count(*) = 3
""")
def stream_custom_state(spark, folder):
    """When each user had viewed, clicked and purchased, over several micro-batches in the
    order of time; each user is given out when the watermark has passed that time."""
    closing = Closing(_replayed(spark, folder, "user_id", "event_type", "ts"), "ts")
    buckets = max(64, table(spark, folder, "events").count() // EVENTS_PER_BUCKET)
    wanted = ["view", "click", "purchase"]
    done = completions(closing.stream, "user_id", "event_type", "ts", wanted, buckets=buckets)
    return run_to_table(done, closing)


@query("SELECT count(*) AS events, 0::BIGINT AS late, 0::BIGINT AS held FROM events")
def stream_accounts(spark, folder):
    """Every event of several micro-batches is in a closed window, reported late or left in
    state: in the order of time none is late, and after the closing row none is left."""
    closing = Closing(_replayed(spark, folder, "event_type", "ts"), "ts")
    counted = (
        closing.stream.withWatermark("ts", "10 minutes")
        .groupBy(F.window("ts", "1 hour").alias("w"), "event_type")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("n")
    )
    run = run_to_end(counted, closing)
    # The closing row's own window stays open.
    return run.rows.agg(F.sum("n").alias("events")).select(
        "events", F.lit(run.late).cast("bigint").alias("late"), F.lit(run.held - 1).cast("bigint").alias("held")
    )
