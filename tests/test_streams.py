"""Streams over several micro-batches, with late rows and restarts."""

import os
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from weftline import scratch
from weftline.streaming.milestones import DAY, completions
import __spark_entry__ as spark_entry
from weftline.sources.tables import table
from weftline.streaming.runs import Closing, replay, run_to_end, run_to_partials, run_to_table

SCHEMA = "user_id long, kind string, ts timestamp"


def stream_of(spark, batches):
    """One JSON file per micro-batch, in the given order."""
    folder = Path(scratch.fresh_path(spark, "in"))
    folder.mkdir(parents=True)
    for number, rows in enumerate(batches):
        file = folder / f"{number}.json"
        file.write_text("\n".join(f'{{"user_id": {u}, "kind": "{k}", "ts": "{t}"}}' for u, k, t in rows))
        os.utime(file, (1_700_000_000 + number * 60,) * 2)
    reader = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1)
    return reader.json(str(folder))


def at(clock):
    return f"2024-01-01T{clock}:00Z"


def test_late_rows_within_the_delay_count_and_later_ones_do_not(spark):
    stream = stream_of(
        spark,
        [
            [(1, "a", at("10:05")), (1, "a", at("10:50"))],
            [(1, "a", at("10:45"))],  # late, but the watermark is 10:40
            [(1, "a", at("13:00"))],  # moves the watermark to 12:50
            [(1, "a", at("13:05"))],  # this batch closes the window from 10:00
            [(1, "a", at("10:55")), (1, "a", at("14:30"))],  # 10:55 is too late
        ],
    )
    counted = (
        stream.withWatermark("ts", "10 minutes")
        .groupBy(F.window("ts", "1 hour").alias("w"))
        .agg(F.count("*").alias("n"))
        .select(F.hour("w.start").alias("h"), "n")
    )
    assert sorted(map(tuple, run_to_table(counted).collect())) == [(10, 3), (13, 2)]


def test_sessions_join_across_batches(spark):
    stream = stream_of(
        spark,
        [
            [(1, "a", at("10:00")), (2, "a", at("10:01"))],
            [(1, "a", at("10:20"))],
            [(3, "a", at("15:00"))],
        ],
    )
    merged = (
        stream.withWatermark("ts", "30 minutes")
        .groupBy("user_id", F.session_window("ts", "30 minutes").alias("s"))
        .agg(F.count("*").alias("n"))
        .select("user_id", "n")
    )
    assert sorted(map(tuple, run_to_table(merged).collect())) == [(1, 2), (2, 1)]


def test_completions_use_state_from_earlier_batches_and_emit_once(spark):
    stream = stream_of(
        spark,
        [
            [(1, "b", at("10:10")), (1, "a", at("10:00")), (2, "a", at("10:00")), (9, "z", at("10:00"))],
            [(1, "c", at("11:00")), (2, "b", at("10:30"))],
            [(1, "a", at("12:00")), (1, "c", at("12:00")), (2, "c", at("10:20"))],
        ],
    )
    closing = Closing(stream, "ts")
    done = run_to_table(completions(closing.stream, "user_id", "kind", "ts", ["a", "b", "c"], delay="3 hours"), closing)
    assert done.columns == ["user_id", "completed"]
    assert sorted((r.user_id, str(r.completed)) for r in done.collect()) == [
        (1, "2024-01-01 11:00:00"),
        (2, "2024-01-01 10:30:00"),
    ]


def test_completions_of_a_hot_key(spark):
    rows = [(7, "abc"[i % 3], f"2024-01-01T00:{i // 60 % 60:02d}:{i % 60:02d}Z") for i in range(3000)]
    closing = Closing(stream_of(spark, [rows]), "ts")
    done = run_to_table(completions(closing.stream, "user_id", "kind", "ts", ["a", "b", "c"]), closing)
    assert [(r.user_id, str(r.completed)) for r in done.collect()] == [(7, "2024-01-01 00:00:02")]


def test_completions_in_any_order_within_the_delay_leave_no_state(spark):
    rng = random.Random(4)
    rows = [(rng.randrange(30), rng.choice("abcz"), f"2024-01-{1 + k // 24:02d}T{k % 24:02d}:00:00Z") for k in range(300)]
    first = {}
    for user, kind, ts in rows:
        first[user, kind] = min(ts, first.get((user, kind), ts))
    users = {u for u, *_ in rows}
    wanted = sorted((u, max(first[u, k] for k in "abc")[:10]) for u in users if all((u, k) in first for k in "abc"))
    newest_first = [rows[k : k + 60] for k in range(0, 300, 60)][::-1]
    for batches in (newest_first, rng.sample(newest_first, 5)):
        closing = Closing(stream_of(spark, batches), "ts")
        run = run_to_end(completions(closing.stream, "user_id", "kind", "ts", ["a", "b", "c"], delay="20 days"), closing)
        got = [(r.user_id, str(r.completed)[:10]) for r in run.rows.collect()]
        assert sorted(got, key=str) == sorted(wanted, key=str)
        assert (run.late, run.held, run.batches) == (0, 0, 6)


def test_completions_forget_keys_after_a_while_and_count_late_rows(spark):
    def day(k, user, kind):
        return (user, kind, f"2024-01-{k:02d}T00:00:00Z")

    batches = [
        [day(1, 1, "a"), day(2, 1, "b"), day(1, 2, "a")],
        [day(10, 3, "a")],  # 1 is given out; what 2 has shown is forgotten
        [day(11, 3, "b"), day(11, 2, "b")],
        [day(12, 1, "a"), day(3, 4, "a")],  # 4 comes too late
        [day(13, 1, "b"), day(30, 5, "a")],
        [day(30, 5, "z")],
    ]
    closing = Closing(stream_of(spark, batches), "ts")
    run = run_to_end(completions(closing.stream, "user_id", "kind", "ts", ["a", "b"], delay="1 day", remember=3 * DAY), closing)
    done = sorted((r.user_id, str(r.completed)[:10]) for r in run.rows.collect())
    assert done == [(1, "2024-01-02"), (1, "2024-01-13"), (3, "2024-01-11")]
    assert (run.late, run.held) == (1, 0)


def test_completions_of_many_keys_share_state(spark):
    rows = [(u, "ab"[k], f"2024-01-01T{(u * (k + 3)) % 24:02d}:00:00Z") for u in range(400) for k in range(1 + u % 2)]
    wanted = sorted((u, max(3 * u % 24, 4 * u % 24)) for u in range(400) if u % 2)
    closing = Closing(stream_of(spark, [rows[::2], rows[1::2]]), "ts")
    stream = completions(closing.stream, "user_id", "kind", "ts", ["a", "b"], delay="2 days", buckets=3)
    run = run_to_end(stream, closing)
    assert sorted((r.user_id, r.completed.hour) for r in run.rows.collect()) == wanted
    assert run.late == 0
    open_run = run_to_end(completions(stream_of(spark, [rows]), "user_id", "kind", "ts", ["a", "b"], delay="2 days", buckets=3))
    assert open_run.held == 3 and open_run.rows.isEmpty()


def test_rows_out_and_rows_late_are_all_rows(spark):
    """Newest first: what the watermark has passed is dropped, and said to be."""
    rows = [(k, "a", f"2024-01-{1 + k // 24:02d}T{k % 24:02d}:30:00Z") for k in range(240)]
    batches = [rows[k : k + 48] for k in range(0, 240, 48)][::-1]
    closing = Closing(stream_of(spark, batches), "ts")
    # One row a window: each dropped group is a row.
    counted = closing.stream.withWatermark("ts", "1 hour").groupBy(F.window("ts", "1 hour")).agg(F.count("*").alias("n")).select("n")
    run = run_to_end(counted, closing)
    given = run.rows.agg(F.sum("n")).first()[0]
    assert run.late > 0 and given + run.late == len(rows) and run.held == 1


def test_replay_keeps_the_order_of_batches(spark):
    seen = []

    def summarise(batch):
        seen.append(batch.agg(F.min("id"), F.max("id")).first())
        return batch

    run_to_partials(replay(spark.range(500).orderBy(F.desc("id")), 5, "id"), summarise)
    assert [tuple(r) for r in seen] == sorted(tuple(r) for r in seen) and len(seen) == 5


def test_replay_gives_every_row_once(spark):
    batches = []

    def summarise(batch):
        batches.append(batch.count())
        return batch.groupBy("k").agg(F.count("*").alias("n"), F.sum("id").alias("s"))

    rows = spark.range(1000).withColumn("k", F.col("id") % 3)
    merged = run_to_partials(replay(rows, 4, "id"), summarise)
    total = merged.agg(F.sum("n"), F.sum("s")).first()
    assert tuple(total) == (1000, 499500)
    assert len(batches) == 4 and sum(batches) == 1000


def test_stream_resumes_without_repeating_rows(spark):
    """A second run over the same progress folder adds only new files."""
    folder = Path(scratch.fresh_path(spark, "in"))
    folder.mkdir(parents=True)
    out = scratch.fresh_path(spark, "out")

    def run():
        stream = spark.readStream.schema("id long").json(str(folder))
        query = (
            stream.writeStream.format("parquet")
            .option("path", f"{out}/rows")
            .option("checkpointLocation", f"{out}/progress")
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
        return sorted(r.id for r in spark.read.parquet(f"{out}/rows").collect())

    (folder / "a.json").write_text('{"id": 1}\n{"id": 2}')
    assert run() == [1, 2]
    (folder / "b.json").write_text('{"id": 3}')
    assert run() == [1, 2, 3]
    assert run() == [1, 2, 3]


def test_unfinished_windows_are_not_emitted(spark):
    stream = stream_of(spark, [[(1, "a", at("10:05"))]])
    counted = (
        stream.withWatermark("ts", "10 minutes")
        .groupBy(F.window("ts", "1 hour").alias("w"))
        .agg(F.count("*").alias("n"))
        .select("n")
    )
    assert run_to_table(counted).isEmpty()


@pytest.mark.parametrize("kind", ["a", "missing"])
def test_completions_without_all_values_stay_silent(spark, kind):
    stream = stream_of(spark, [[(1, kind, at("10:00"))]])
    assert run_to_table(completions(stream, "user_id", "kind", "ts", ["a", "b"])).isEmpty()


def test_closing_gives_out_the_last_windows(spark):
    stream = stream_of(spark, [[(1, "a", at("10:05"))], [(1, "a", at("10:10")), (2, "b", at("11:00"))]])
    closing = Closing(stream, "ts")
    counted = (
        closing.stream.withWatermark("ts", "10 minutes")
        .groupBy(F.window("ts", "1 hour").alias("w"))
        .agg(F.count("*").alias("n"))
        .select(F.hour("w.start").alias("h"), "n")
    )
    assert sorted(map(tuple, run_to_table(counted, closing).collect())) == [(10, 2), (11, 1)]


@pytest.mark.parametrize("name", sorted(n for n in spark_entry.queries() if n.startswith("stream_")))
def test_a_folder_of_part_files_gives_the_rows_of_one_file(spark, small, name):
    folder = scratch.fresh_path(spark, "parts")
    for t in ("events", "customer", "nation"):
        table(spark, small, t).repartition(3).write.parquet(f"{folder}/{t}.parquet")
    run = spark_entry.queries()[name]
    of_file = sorted(map(tuple, run(spark, small).collect()))
    assert of_file and sorted(map(tuple, run(spark, folder).collect())) == of_file
