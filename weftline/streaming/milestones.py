"""A custom stateful operator: when has a key shown all of a set of values?"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from weftline.streaming.reduce import earliest_per_batch

DAY = 86_400


def completions(
    stream: DataFrame,
    key: str,
    value: str,
    time: str,
    wanted: Sequence[str],
    *,
    delay: str = "10 minutes",
    remember: int = 400 * DAY,
    buckets: int = 64,
) -> DataFrame:
    """Emit each key once, with the time at which it had shown every wanted value.

    Rows may come in any order as long as none is more than ``delay`` older than the
    newest before it; later ones are dropped. A key is held until the watermark has passed
    its completion, when no earlier row can change it, and then emitted by a timer. What
    a key has shown, or that it was emitted, is forgotten ``remember`` seconds of event time
    after its latest row: state is bounded by the keys of that time, and a key that comes
    back later starts anew. Null keys, values and times are left out.

    Each task first reduces its rows to the earliest time per key and value, so
    a hot key sends a handful of rows on. State holds one time per key and wanted value. Keys
    share state in so many ``buckets`` by their hash, as a call of Python for each costs
    far more than its rows: choose some hundred live keys a bucket, as a batch rewrites the
    buckets that it touches. A stream that resumes needs the number it began with.
    """
    wanted = tuple(wanted)
    counts = F.col(value).isin(*wanted) & F.col(key).isNotNull()
    # Other rows go on without key and value, one a batch: they move the watermark too.
    counts = F.coalesce(counts, F.lit(False))
    rows = stream.select(
        counts.alias("counts"),
        F.when(counts, F.col(key).cast("bigint")).otherwise(0).alias("key"),
        F.when(counts, F.col(value)).alias("value"),
        F.unix_micros(F.col(time).cast("timestamp")).alias("micros"),
    )
    reduced = earliest_per_batch(rows.where("micros IS NOT NULL"), ["counts", "key", "value"], "micros")
    bucket = F.when(F.col("counts"), F.pmod(F.xxhash64("key"), F.lit(buckets))).otherwise(-1)
    timed = reduced.withColumns({"at": F.timestamp_micros("micros"), "bucket": bucket}).withWatermark("at", delay)
    done = timed.select("bucket", "key", "value", "micros", "at").groupBy("bucket").applyInPandasWithState(
        _completion(wanted, remember * 1000),
        outputStructType=T.StructType(
            [T.StructField("key", T.LongType()), T.StructField("micros", T.LongType())]
        ),
        stateStructType=T.StructType([T.StructField("held", T.BinaryType())]),
        outputMode="append",
        timeoutConf=GroupStateTimeout.EventTimeTimeout,
    )
    at = F.timestamp_micros("micros").cast("timestamp_ntz")
    return done.select(F.col("key").alias(key), at.alias("completed"))


def _completion(wanted: tuple[str, ...], remember: int):
    """Of each key of a bucket, in order: when it was last seen, when it is due (at its
    completion, or else to be forgotten), whether it was emitted, the earliest time of
    each value. The bucket's timer is that of the key that is due first."""
    place = {value: k for k, value in enumerate(wanted)}
    never = np.iinfo(np.int64).max
    kind = np.dtype([("key", "<i8"), ("latest", "<i8"), ("due", "<i8"), ("emitted", "?"), ("firsts", "<i8", (len(wanted),))])

    def completed(held: np.ndarray) -> np.ndarray:
        return np.where(held["emitted"], never, held["firsts"].max(axis=1))

    def merged(held: np.ndarray, part: pd.DataFrame) -> np.ndarray:
        """With the rows of a batch; what came before a key was emitted counts no more."""
        keys, micros = part["key"].to_numpy(np.int64), part["micros"].to_numpy(np.int64)
        out = np.zeros(len(known := np.union1d(held["key"], keys)), kind)
        out["key"], out["firsts"] = known, never
        out[np.searchsorted(known, held["key"])] = held
        at = np.searchsorted(known, keys)
        np.maximum.at(out["latest"], at, micros // 1000)
        value = np.array([place[v] for v in part["value"]], np.int64)
        new = ~out["emitted"][at]
        np.minimum.at(out["firsts"], (at[new], value[new]), micros[new])
        seen = np.unique(at)
        done = completed(out[seen])
        out["due"][seen] = np.where(done == never, out["latest"][seen] + remember, -(-done // 1000))
        return out

    def settled(held: np.ndarray, now: int) -> tuple[np.ndarray, pd.DataFrame]:
        """What is held on, and the keys that are given out, with their times."""
        due = held["due"] <= now
        at = np.where(due, completed(held), never)
        given = at != never
        forget = np.maximum(held["latest"], np.where(given, at // 1000, 0)) + remember
        out = pd.DataFrame({"key": held["key"][given], "micros": at[given]})
        held = held.copy()
        held["due"][given], held["emitted"][given], held["firsts"][given] = forget[given], True, never
        return held[~due | (given & (forget > now))], out

    def step(bucket, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if bucket[0] < 0:
            return
        now = state.getCurrentWatermarkMs()
        # Spark fires timers after the rows of a batch; keys that are due come first.
        held, out = settled(np.frombuffer(state.get[0] if state.exists else b"", kind), now)
        given = [out]
        if not state.hasTimedOut:
            for part in parts:
                held = merged(held, part)
            held, out = settled(held, now)
            given.append(out)
        if len(held):
            state.update((held.tobytes(),))
            state.setTimeoutTimestamp(int(held["due"].min()))
        elif state.exists:
            state.remove()
        yield from (out for out in given if len(out))

    return step
