"""Join operators against brute force on small inputs with one hot key."""

import random
from pathlib import Path

import pytest
from pyspark.sql import Window, functions as F

from test_ordered import same_rows
from weftline import scratch
from weftline.operators.joins import (
    as_of_join,
    count_below,
    full_outer_join,
    interval_join,
    null_safe_join,
    range_join,
    range_join_any,
)
from weftline.operators.ordered import order_rows, spread

START = "TIMESTAMP_NTZ'2024-01-01 00:00:00'"


def timed(spark, n, step, hot):
    seconds = f"int(id * {step} % 5000)"
    return spark.range(n).selectExpr(
        f"CASE WHEN id % 3 = 0 THEN {hot} WHEN id % 31 = 1 THEN NULL ELSE id % 9 END AS k",
        "id",
        f"{START} + make_interval(0, 0, 0, 0, 0, 0, {seconds}) AS t",
    )


@pytest.fixture(scope="module")
def sides(spark):
    left = timed(spark, 150, 37, 4)
    right = timed(spark, 90, 53, 4).select("k", "t", F.col("id").alias("rid"), (F.col("id") * 2).alias("v"))
    return left, right


def brute_as_of(left, right, tolerance=None):
    r = right.select(F.col("k").alias("rk"), F.col("t").alias("rt"), "rid", "v")
    cond = (F.col("k") == F.col("rk")) & (F.col("rt") <= F.col("t"))
    if tolerance:
        cond &= F.timestamp_diff("SECOND", F.col("rt"), F.col("t")) <= tolerance
    best = Window.partitionBy("id").orderBy(F.desc("rt"), F.desc("rid"))
    return (
        left.join(r, cond, "left")
        .withColumn("n", F.row_number().over(best))
        .where("n = 1")
        .select("k", "id", "t", F.col("rt").alias("matched_t"), "rid", "v")
    )


@pytest.mark.parametrize("slices", [None, 1, 30])
@pytest.mark.parametrize("tolerance", [None, 90])
def test_as_of(sides, slices, tolerance):
    left, right = sides
    # Some times are null on either side, and so are some keys.
    left = left.withColumn("t", F.when(F.col("id") % 11 > 0, F.col("t")))
    right = right.withColumn("t", F.when(F.col("rid") % 7 > 0, F.col("t")))
    got = as_of_join(left, right, ["k"], "t", ties=["rid"], tolerance=tolerance, slices=slices)
    same_rows(got, brute_as_of(left, right, tolerance))


def test_as_of_refuses_clashing_columns(sides):
    left, _ = sides
    with pytest.raises(ValueError):
        as_of_join(left, left, ["k"], "t")


def test_interval_join(sides):
    left, right = sides
    right = right.withColumnRenamed("t", "rt")
    expected = (
        left.join(right.withColumnRenamed("k", "rk"), F.expr("k = rk AND rt >= t AND rt <= t + INTERVAL 5 MINUTES"))
        .drop("rk")
    )
    assert expected.count() > 0
    same_rows(interval_join(left, right, ["k"], "t", "rt", 300), expected)


@pytest.mark.parametrize("width", [3.0, 20.0, 1000.0])
def test_range_join(spark, width):
    points = spark.range(200).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 50.0D ELSE id * 1.7D - 90 END AS x")
    ranges = spark.range(40).selectExpr("id AS r", "id * 6.0D - 100 AS lo", "id * 6.0D - 100 + id AS hi")
    expected = points.join(ranges, F.col("x").between(F.col("lo"), F.col("hi")))
    assert expected.count() > 0
    same_rows(range_join(points, ranges, "x", "lo", "hi", width), expected)


@pytest.mark.parametrize("slices", [None, 20])
@pytest.mark.parametrize("keys", [[], ["k"]])
def test_count_below(sides, keys, slices):
    left = sides[0].select("k", "id", F.when(F.col("id") % 13 > 0, F.col("id") % 40).alias("a"))
    right = sides[1].select("k", F.when(F.col("rid") % 7 > 0, F.col("rid") % 35).alias("b"))
    on = F.col("b") < F.col("a")
    if keys:
        on &= F.col("k") == F.col("rk")
    expected = (
        left.join(right.withColumnRenamed("k", "rk"), on, "left")
        .groupBy("k", "id", "a")
        .agg(F.count("b").alias("n"))
    )
    same_rows(count_below(left, right, "a", "b", "n", keys, slices=slices), expected)


def test_full_outer_join(sides):
    left = sides[0].select("k", "id")
    right = sides[1].where("k IS NULL OR k <> 2").select((F.col("k") + 3).alias("j"), "rid")
    expected = left.join(right, F.col("k") == F.col("j"), "full")
    same_rows(full_outer_join(left, right, [("k", "j")]), expected)


def test_null_safe_join(sides):
    left = sides[0].select("k", "id")
    right = sides[1].select(F.col("k").alias("j"), "rid")
    expected = left.join(right, F.expr("k <=> j"))
    same_rows(null_safe_join(left, right, [("k", "j")]), expected)


def test_left_rows_of_one_time_and_key_spread_over_slices(spark):
    """Half of the left rows ask about the same key at the same time."""
    left = spark.range(400).selectExpr(
        "1 AS k", "id", f"{START} + make_interval(0, 0, 0, 0, 0, 0, if(id % 2 = 0, 100, id)) AS t"
    )
    right = spark.range(20).selectExpr(
        "1 AS k", f"{START} + make_interval(0, 0, 0, 0, 0, 0, id * 11) AS t", "id AS rid", "id AS v"
    )
    got = as_of_join(left, right, ["k"], "t", ties=["rid"], slices=20)
    same_rows(got, brute_as_of(left, right))
    rows = left.withColumn("s", spread(left))
    ordered = order_rows(rows, ["k"], ["t", "s"], slices=20)
    sizes = ordered.df.groupBy("_slice").count()
    assert sizes.agg(F.max("count")).first()[0] < 100


@pytest.mark.parametrize("bits, rows_per_slice", [(1, 2_000_000), (3, 2_000_000), (2, 40)])
def test_range_join_of_any_widths_equals_brute_force(spark, bits, rows_per_slice):
    rng = random.Random(bits)
    points = [(k, rng.choice([rng.randrange(-50, 50), 7, 7])) for k in range(150)] + [(900, None), (901, 7), (901, 7)]
    ranges = [(k, low, low + rng.choice([0, 0, 1, 5, 60, 200])) for k in range(60) for low in [rng.randrange(-70, 70)]]
    ranges += [(100, -1000, 1000), (101, 5, 4), (102, None, 3), (103, 3, None), (104, 1000, 2000), (105, 7, 7), (105, 7, 7)]
    left = spark.createDataFrame(points, "p long, v long").repartition(3)
    right = spark.createDataFrame(ranges, "r long, low long, high long").repartition(3)
    got = range_join_any(left, right, "v", "low", "high", bits=bits, rows_per_slice=rows_per_slice)
    assert got.columns == ["p", "v", "r", "low", "high"]
    wanted = [(*p, *r) for p in points for r in ranges if None not in (p[1], *r) and r[1] <= p[1] <= r[2]]
    assert sorted(map(tuple, got.collect())) == sorted(wanted)
    assert range_join_any(left.limit(0), right, "v", "low", "high").count() == 0
    assert range_join_any(left, right.limit(0), "v", "low", "high").count() == 0


def test_a_range_over_everything_is_few_rows(spark):
    points = spark.range(10_000).select(F.col("id").alias("v"))
    ranges = spark.createDataFrame([(1, 0, 9_999), (2, 1, 9_998)], "r long, low long, high long")
    got = range_join_any(points, ranges, "v", "low", "high")
    assert got.groupBy("r").count().orderBy("r").collect() == [(1, 10_000), (2, 9_998)]
    written = sorted(Path(scratch.shared_folder(spark)).glob("*/pieces-*"), key=lambda p: p.stat().st_mtime)
    pieces = spark.read.parquet(str(written[-1]))
    assert pieces.where("r = 1").count() <= 16 and pieces.where("r = 2").count() <= 16 * 5
