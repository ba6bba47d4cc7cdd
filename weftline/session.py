"""Session settings."""

from __future__ import annotations

from importlib import import_module

from pyspark import cloudpickle
from pyspark.sql import SparkSession

# Settings that can be changed on a running session. Executor counts, memory
# and spark.checkpoint.dir belong to the cluster's own configuration.
RUNTIME_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a skewed join even when that costs one more exchange downstream.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Merge rows into sessions before the exchange, so that a hot key ships
    # sessions rather than rows.
    "spark.sql.sessionWindow.merge.sessions.in.local.partition": "true",
    # A task that writes to few buckets or folders need not sort rows by them.
    "spark.sql.maxConcurrentOutputFileWriters": "4",
    # Streaming state off the JVM heap, with each commit writing only changes.
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # Data sources in Python are told of filters.
    "spark.sql.python.filterPushdown.enabled": "true",
    # Python sees batches bounded by bytes, so long texts do not make them large.
    "spark.sql.execution.arrow.maxBytesPerBatch": "4m",
    # Stream-stream joins keep their state in one store per partition, not four.
    "spark.sql.streaming.join.stateFormatVersion": "3",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to an existing session, where it has none of its own."""
    given = spark.conf.getAll
    for name, value in RUNTIME_SETTINGS.items():
        if name not in given:
            spark.conf.set(name, value)
    return spark


def share_code() -> None:
    """Send this package's Python functions to the workers by value, for clusters
    and processes where workers cannot import it."""
    cloudpickle.register_pickle_by_value(import_module("weftline"))


def build_session(
    master: str | None = None, shuffle_partitions: int | None = None, **conf: str
) -> SparkSession:
    """Create a session. On a cluster, leave ``master`` to spark-submit."""
    builder = SparkSession.builder.appName("weftline")
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = builder.config("spark.sql.session.timeZone", "UTC")
    for name, value in {**RUNTIME_SETTINGS, **conf}.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()
