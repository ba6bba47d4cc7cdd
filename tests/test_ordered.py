"""Sliced windows against plain windows, on keys that are skewed and tiny."""

import pytest
from pyspark.sql import Window, functions as F

from weftline.operators.ordered import SLICE, order_rows


@pytest.fixture(scope="module")
def rows(spark):
    # Key 0 holds a third of the rows; keys from 5 on have one or two rows.
    return (
        spark.range(600)
        .select(
            F.when(F.col("id") % 3 == 0, 0)
            .when(F.col("id") < 500, F.col("id") % 5)
            .otherwise(F.col("id"))
            .alias("k"),
            F.col("id"),
            (F.col("id") * 7919 % 601).alias("t"),
            F.when(F.col("id") % 11 == 0, F.col("id") * 3).alias("v"),
        )
        .withColumn("k", F.when(F.col("id") % 97 == 1, None).otherwise(F.col("k")))
    )


def same_rows(a, b):
    columns = sorted(a.columns)
    left, right = a.select(columns), b.select(columns)
    assert left.count() == right.count()
    assert left.exceptAll(right).isEmpty() and right.exceptAll(left).isEmpty()


@pytest.mark.parametrize("split", [{"slices": 7}, {"slices": 40}, {"rows_per_slice": 30}])
@pytest.mark.parametrize("order", [("t", "id"), ("t desc", "id desc")])
@pytest.mark.parametrize("keys", [("k",), ()])
def test_sliced_equals_plain(rows, keys, order, split):
    def run(ordered):
        ordered = ordered.with_row_number("rn").with_running(
            s=("sum", "v"), c=("count", "v"), lo=("min", "v"), hi=("max", "v"), la=("last", "v")
        )
        ordered = ordered.with_frame(before=3, after=1, moving=F.sum("id"), n=F.count("v"))
        return ordered.with_shifted(lag2=("id", -2), lead2=("id", 2), far=("id", -45)).result()

    same_rows(
        run(order_rows(rows, keys, order, **split)), run(order_rows(rows, keys, order))
    )


@pytest.mark.parametrize("split", [{}, {"slices": 1}, {"slices": 40}, {"rows_per_slice": 30}])
@pytest.mark.parametrize("order", [("t", "id"), ("t desc", "id desc")])
def test_equals_spark_windows(rows, split, order):
    w = Window.partitionBy("k").orderBy(*[F.desc(c[:-5]) if " " in c else F.asc(c) for c in order])
    near = w.rowsBetween(-3, 1)
    expected = rows.withColumns(
        {"last_v": F.last("v", ignorenulls=True).over(w), "moving": F.sum("id").over(near), "lag": F.lag("id", 3).over(w)}
    )
    got = order_rows(rows, ["k"], list(order), **split).with_running(last_v=("last", "v"))
    got = got.with_frame(before=3, after=1, moving=F.sum("id")).with_shifted(lag=("id", -3))
    same_rows(got.result(), expected)


def test_too_many_slices_are_refused(rows):
    with pytest.raises(ValueError):
        order_rows(rows, ["k"], ["t"], rows_per_slice=10, max_slices=5)


def test_large_key_is_sliced(rows):
    assert not order_rows(rows, ["k"], ["t"], rows_per_slice=1000).sliced
    ordered = order_rows(rows, ["k"], ["t", "id"], rows_per_slice=50)
    assert ordered.sliced
    sizes = ordered.df.groupBy("k", "_slice").count()
    assert sizes.agg(F.max("count")).first()[0] < 150
    # Only the large keys are set apart; the others keep plain windows.
    assert ordered.df.select("k").distinct().count() < rows.select("k").distinct().count()
    assert not ordered.rest.sliced
    assert ordered.df.count() + ordered.rest.df.count() == rows.count()


def test_equal_order_values_stay_in_one_slice(rows):
    ordered = order_rows(rows.withColumn("t", F.col("t") % 4), ["k"], ["t"], slices=16)
    spread = ordered.df.groupBy("k", "t").agg(F.count_distinct("_slice").alias("n"))
    assert spread.agg(F.max("n")).first()[0] == 1


@pytest.mark.parametrize("slices", [7, 40])
def test_each_slice_has_its_own_bucket(rows, slices):
    cut = order_rows(rows, ["k"], ["t", "id"], slices=slices).df
    found = cut.select(SLICE).distinct().withColumn("b", F.pmod(F.hash(SLICE), F.lit(slices)))
    assert found.count() == slices == found.select("b").distinct().count()
