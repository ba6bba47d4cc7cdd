from pathlib import Path

from weftline.scratch import written


def test_a_written_table_leaves_no_shuffle_files(spark):
    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()

    def files():
        return {f for d in folders for f in Path(str(d)).rglob("shuffle_*.data")}

    before = files()
    rows = written(spark.range(0, 5000, 1, 4).repartition(5, "id"))
    assert rows.count() == 5000
    written(rows.groupBy("id").count())
    assert not {f for f in files() - before if f.stat().st_size > 4000}
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
