"""Reading tables as streams and running streams to the end of their input."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from threading import Event

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQueryListener

from weftline.scratch import fresh_path
from weftline.sources.tables import table


# Bytes of new files that one micro-batch takes at most.
BATCH_BYTES = 8 << 30
# Later than every event, so that its watermark closes all windows, and within the times
# that Python operators can hold.
END_OF_TIME = "2262-01-01 00:00:00"


def table_stream(
    spark: SparkSession, folder: str, name: str, batch_bytes: int = BATCH_BYTES
) -> DataFrame:
    """The files of one table as a stream, be it one file or a folder of part files."""
    schema = table(spark, folder, name).schema
    reader = spark.readStream.schema(schema).option("maxBytesPerTrigger", str(batch_bytes))
    # Written as a pattern: a pattern may match a file, a plain path only a folder.
    return reader.parquet(f"{folder}/{name}.parque[t]")


class Closing:
    """A stream with an end: once all input is read, a row at the end of time moves the
    watermark past every window, so that the last ones are given out too. That row's own
    window never closes."""

    def __init__(self, stream: DataFrame, time: str):
        self._spark = stream.sparkSession
        self._folder = fresh_path(self._spark, "ending")
        self._row = self._spark.createDataFrame([], stream.schema)
        self._row.write.parquet(self._folder)
        self._time = time
        ending = self._spark.readStream.schema(stream.schema).parquet(self._folder)
        self.stream = stream.unionByName(ending)

    def end(self) -> None:
        schema = self._row.schema
        cells = [
            F.lit(END_OF_TIME if f.name == self._time else None).cast(f.dataType).alias(f.name) for f in schema
        ]
        self._spark.range(1).select(*cells).write.mode("append").parquet(self._folder)


def replay(df: DataFrame, files: int, order: str) -> DataFrame:
    """``df`` as a stream of several files, one per micro-batch, in the order of a column.

    A file source takes files by the time at which they were written, so the ranges
    are cut once and then written one after another.
    """
    spark = df.sparkSession
    cut = fresh_path(spark, "ranges")
    ranged = df.repartitionByRange(files, F.col(order)).withColumn("_range", F.spark_partition_id())
    ranged.write.partitionBy("_range").parquet(cut)
    ranges = spark.read.schema(ranged.schema).parquet(cut)
    path = fresh_path(spark, "replay")
    for number in range(files):
        ranges.where(F.col("_range") == number).drop("_range").coalesce(1).write.mode("append").parquet(path)
    reader = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1)
    return reader.parquet(path)


@dataclass(frozen=True)
class Run:
    """What a finished stream wrote, and what it reports: micro-batches with input, rows that
    stateful operators dropped as later than the watermark (after any partial step before
    them), and rows left in their state."""

    rows: DataFrame
    batches: int
    late: int
    held: int


def run_to_table(stream: DataFrame, closing: Closing | None = None) -> DataFrame:
    """The rows of ``run_to_end``."""
    return run_to_end(stream, closing).rows


def run_to_end(stream: DataFrame, closing: Closing | None = None) -> Run:
    """Run an append-mode stream over all available input.
    With ``closing``, whose stream it must come from, its open windows are closed too; what
    comes after that row is late, so a closed progress folder takes no further input.

    Progress, state and output live in the shared folder, so a lost executor or
    driver resumes from the last committed batch.
    """
    spark = stream.sparkSession
    path = fresh_path(spark, "stream")
    watched = _Watch()
    spark.streams.addListener(watched)
    try:
        for last in (False, True) if closing else (True,):
            _finish(
                stream.writeStream.format("parquet")
                .outputMode("append")
                .option("path", f"{path}/rows")
                .option("checkpointLocation", f"{path}/progress"),
                watched,
            )
            if not last:
                closing.end()
    finally:
        spark.streams.removeListener(watched)
    rows = spark.read.schema(stream.schema).parquet(f"{path}/rows")
    return Run(rows, watched.batches, watched.late, watched.held)


def run_to_partials(
    stream: DataFrame, summarise: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """Write each micro-batch's summary; return all of them for a final merge.

    A batch overwrites its own folder, so a repeated batch leaves one copy.
    """
    spark = stream.sparkSession
    path = fresh_path(spark, "partials")

    def write(batch: DataFrame, number: int) -> None:
        summarise(batch).write.mode("overwrite").parquet(f"{path}/rows/batch={number}")

    _finish(
        stream.writeStream.foreachBatch(write)
        .outputMode("append")
        .option("checkpointLocation", f"{path}/progress")
    )
    return spark.read.parquet(f"{path}/rows").drop("batch")


class _Watch(StreamingQueryListener):
    """Adds up the progress of the runs that it is told of; progress itself keeps the last
    hundred batches only."""

    def __init__(self) -> None:
        self.batches = self.late = self.held = 0
        self._of: dict[str, list] = {}
        self._ended: dict[str, Event] = {}

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        self._of.setdefault(str(event.progress.runId), []).append(event.progress)

    def onQueryTerminated(self, event) -> None:
        self._ended.setdefault(str(event.runId), Event()).set()

    def add(self, run: str) -> None:
        """Events come a little after the run has ended."""
        if not self._ended.setdefault(run, Event()).wait(60):
            raise TimeoutError("the stream's last progress was not reported")
        progress = sorted(self._of.get(run, []), key=lambda p: p.batchId)
        self.batches += sum(p.numInputRows > 0 for p in progress)
        self.late += sum(o.numRowsDroppedByWatermark for p in progress for o in p.stateOperators)
        self.held = sum(o.numRowsTotal for o in progress[-1].stateOperators) if progress else self.held


def _finish(writer: DataStreamWriter, watched: _Watch | None = None) -> None:
    running = writer.trigger(availableNow=True).start()
    running.awaitTermination()
    if watched:
        watched.add(str(running.runId))
