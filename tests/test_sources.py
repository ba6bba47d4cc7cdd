"""Files, the ltsv source, written tables and the shared folder."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F, types as T

from test_ordered import same_rows
from weftline import scratch
from weftline.sources.files import LOSSLESS, read_files, round_trip, write_files
from weftline.sources.ltsv import LtsvSource
from weftline.sources.tables import register_views, table


@pytest.fixture(scope="module")
def odd(spark):
    """Values that formats tend to lose."""
    data = [
        (1, 'say "hi", ok', 0.1, True),
        (2, " padded ", -1e300, False),
        (3, "back\\slash;tab\tend", 5e-324, None),
        (4, "été 漢字", None, True),
        (None, "x", 3.0, True),
        (6, "", 1.0, True),
        (7, None, 1.0, True),
        (8, "line\nend\r\n and \\n, \\N |bars|", 1.0, True),
        (9, "\\N", 1.0, True),
        (10, "  ", 1.0, True),
    ]
    frame = spark.createDataFrame(data, "n long, s string, x double, b boolean")
    times = F.expr("TIMESTAMP_NTZ'2024-02-29 23:59:59.123456' + make_interval(0, 0, 0, n)")
    return frame.withColumns({"t": times, "d": times.cast("date")})


@pytest.mark.parametrize("kind", sorted(LOSSLESS))
def test_round_trip(odd, kind):
    same_rows(round_trip(odd, kind), odd)


def test_partitioned_files_are_few_and_whole(spark, medium):
    orders = table(spark, medium, "orders").withColumn("y", F.year("o_orderdate"))
    path = scratch.fresh_path(spark, "t")
    write_files(orders, path, "orc", partition_by=["y"])
    same_rows(read_files(spark, path, "orc", orders.schema), orders)
    for folder in Path(path).glob("y=*"):
        assert len(list(folder.glob("*.orc"))) <= 3


def test_write_keeps_existing_files(spark, odd):
    path = scratch.fresh_path(spark, "t")
    write_files(odd, path, "parquet")
    with pytest.raises(Exception, match="already exists"):
        write_files(odd, path, "parquet")


@pytest.mark.parametrize("split", [7, 64, 1 << 20])
def test_ltsv(spark, split):
    spark.dataSource.register(LtsvSource)
    data = [
        (i, ["plain", "tab\tand\nline", "c:\\n\\t\r", "", None, "é:漢"][i % 6], i / 3 if i % 4 else None)
        for i in range(200)
    ]
    frame = spark.createDataFrame(data, "n long, s string, x double").repartition(3)
    path = scratch.fresh_path(spark, "ltsv")
    frame.write.format("ltsv").mode("append").save(path)
    got = spark.read.format("ltsv").schema(frame.schema).option("splitBytes", str(split)).load(path)
    same_rows(got, frame)
    frame.limit(5).write.format("ltsv").mode("overwrite").save(path)
    assert spark.read.format("ltsv").schema(frame.schema).load(path).count() == 5
    assert not list(Path(path).glob("*.tmp"))


def test_ltsv_reads_some_of_the_labels(spark):
    folder = Path(scratch.fresh_path(spark, "ltsv"))
    folder.mkdir()
    (folder / "a.ltsv").write_text("a:1\tb:x\nb:y\tz:9\n\na:3")
    got = spark.read.format("ltsv").schema("a int, b string").load(str(folder)).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, "x"), (None, "y"), (None, None), (3, None)], key=str)


def test_ltsv_filters_where_the_rows_are_read(spark):
    spark.dataSource.register(LtsvSource)
    data = [(i if i % 7 else None, ["a", "b\tc", None, ""][i % 4], i % 3 == 0, i / 2) for i in range(300)]
    frame = spark.createDataFrame(data, "n long, s string, b boolean, x double")
    path = scratch.fresh_path(spark, "ltsv")
    frame.write.format("ltsv").mode("append").save(path)
    got = spark.read.format("ltsv").schema(frame.schema).load(path)
    for condition in ("n = 5", "n > 100 AND s = 'b\tc'", "n IS NULL", "s IS NOT NULL AND n <= 40", "n IN (1, 2, 7, 1000)", "b AND x < 20", "s = ''", "x = 3.5", "n = 5 OR s IS NULL", "NOT (n < 250)"):
        same_rows(got.where(condition), frame.where(condition))
    read = [m["numOutputRows"] if isinstance(m, dict) else m for m in [_rows_scanned(got.where("n = 5"))]]
    assert read == [1]


def _rows_scanned(frame):
    frame.collect()
    plan = frame._jdf.queryExecution().executedPlan()
    scan = plan.collectLeaves().head()
    return scan.metrics().apply("numOutputRows").value()


def test_ltsv_repeated_and_bare_labels(spark):
    folder = Path(scratch.fresh_path(spark, "ltsv"))
    folder.mkdir()
    (folder / "a.ltsv").write_text("a:1\ta:2\tb\nba:x\tb:\\\\t\\\\\\t\\q\n")
    spark.dataSource.register(LtsvSource)
    got = spark.read.format("ltsv").schema("a int, b string").load(str(folder)).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(2, ""), (None, "\\t\\\t\\q")], key=str)


def test_ltsv_needs_a_schema(spark):
    spark.dataSource.register(LtsvSource)
    with pytest.raises(Exception, match="schema"):
        spark.read.format("ltsv").load("/tmp")


def test_views_answer_sql(spark, small):
    register_views(spark, small)
    assert spark.sql("SELECT count(*) FROM nation JOIN region ON n_regionkey = r_regionkey").first()[0] == 25


def test_written_keeps_rows_and_types(odd):
    same_rows(scratch.written(odd), odd)
    assert scratch.written(odd).schema == odd.schema or isinstance(odd.schema, T.StructType)


class _Session:
    """Stands in for a session on a cluster."""

    def __init__(self, named):
        class Conf:
            get = staticmethod(lambda key, default: named)

        class Context:
            master, applicationId = "spark://cluster:7077", "app-1"

        self.conf, self.sparkContext = Conf, Context


def test_shared_folder_is_the_one_the_cluster_names():
    assert scratch.shared_folder(_Session("hdfs://store/cuts/")) == "hdfs://store/cuts"


def test_no_machine_local_folder_on_a_cluster():
    with pytest.raises(RuntimeError):
        scratch.shared_folder(_Session(None))
