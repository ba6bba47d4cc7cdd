"""Tables written to the cluster's shared folder to cut lineage.

A written table outlives the executors that made it, and every later read sees
the same rows in the same slices, which a recomputed plan cannot promise.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

# Fixed value: the most buckets Spark allows by default.
MAX_BUCKETS = 100_000

_local_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one in local mode."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    app = context.applicationId
    if app not in _local_folders:
        _local_folders[app] = tempfile.mkdtemp(prefix="spark-")
    return _local_folders[app]


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path that nothing has used before, in the application's own part of the
    shared folder. That part can be removed once the application has ended."""
    app = spark.sparkContext.applicationId
    return f"{shared_folder(spark)}/{app}/{label}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what runs within go when it ends, not when the driver next
    collects its garbage: once a table is written nothing reads them."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def written(df: DataFrame, label: str = "cut") -> DataFrame:
    """Write ``df`` once as Parquet and return a scan of the written files."""
    path = fresh_path(df.sparkSession, label)
    with shuffles_dropped(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(rows: DataFrame) -> None:
    """Remove the files of a written table that nothing reads any more."""
    for folder in {name.rsplit("/", 1)[0] for name in rows.inputFiles()}:
        store, path = fs.FileSystem.from_uri(folder)
        store.delete_dir(path)


def written_buckets(
    df: DataFrame, columns: Sequence[str], buckets: int, label: str = "buckets"
) -> DataFrame:
    """``written``, hashed into buckets by ``columns``.

    Grouping by them, or by them and others, then needs no exchange, and neither
    does a join of tables bucketed alike. The rows are written from where they
    are: partition them by ``columns`` first to get few files.
    """
    spark = df.sparkSession
    name = f"{label}_{uuid.uuid4().hex}"
    if buckets > MAX_BUCKETS:
        raise ValueError(f"{buckets} buckets; Spark allows {MAX_BUCKETS}")
    writer = df.write.bucketBy(buckets, *columns)
    writer.option("path", fresh_path(spark, label)).saveAsTable(name)
    rows = spark.table(name)
    # The plan keeps the files and their bucketing; the catalog entry can go.
    spark.sql(f"DROP TABLE {name}")
    return rows
