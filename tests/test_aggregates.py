"""Aggregate and timed operators against plain Spark or numpy."""

import numpy as np
import pytest
from pyspark.sql import Window, functions as F

from test_joins import START
from test_ordered import same_rows
from weftline.functions.columns import cents, exact_sum, time_bucket
from weftline.functions.vectorized import elementwise_max, luhn_digit
from weftline.operators.aggregates import (
    mode,
    ntile,
    quantiles,
    summed_sets,
    top_k,
    value_ranks,
    with_group_values,
)
from weftline.operators.blocks import apply_in_blocks
from weftline.operators.timed import sessions, time_frame, trailing_sums


@pytest.fixture(scope="module")
def rows(spark):
    # Half of all values are equal, and key 0 holds a third of the rows.
    return spark.range(300).selectExpr(
        # Key 99 has nulls alone.
        "CASE WHEN id % 3 = 0 THEN 0 WHEN id = 5 THEN NULL WHEN id % 17 = 3 AND id > 200 THEN 99 ELSE id % 7 END AS k",
        "id",
        "CASE WHEN id % 17 = 3 THEN NULL WHEN id % 2 = 0 THEN 5.5D ELSE id * 37 % 101 * 1.0D END AS v",
        f"{START} + make_interval(0, 0, 0, 0, 0, 0, int(id * 41 % 20000)) AS t",
    )


@pytest.mark.parametrize("slices", [None, 25])
def test_quantiles(rows, slices):
    probabilities = {"p0": 0.0, "p33": 0.33, "p50": 0.5, "p100": 1.0}
    got = {r.k: r for r in quantiles(rows, ["k"], "v", probabilities, slices=slices).collect()}
    values = {}
    for r in rows.collect():
        values.setdefault(r.k, []).extend([] if r.v is None else [r.v])
    assert set(got) == set(values) and values[99] == []
    for key, found in values.items():
        for name, p in probabilities.items():
            if not found:
                assert got[key][name] is None
                continue
            assert got[key][name] == pytest.approx(np.quantile(found, p), abs=1e-9)


@pytest.mark.parametrize("slices", [None, 25])
@pytest.mark.parametrize("order", ["v", "v desc"])
def test_value_ranks(rows, order, slices):
    w = Window.partitionBy("k").orderBy(F.desc("v") if order.endswith("desc") else F.asc("v"))
    expected = rows.withColumns(
        {
            "rank": F.rank().over(w).cast("bigint"),
            "dense_rank": F.dense_rank().over(w).cast("bigint"),
            "percent_rank": F.percent_rank().over(w),
            "cume_dist": F.cume_dist().over(w),
        }
    )
    same_rows(value_ranks(rows, ["k"], order, slices=slices), expected)


@pytest.mark.parametrize("tiles", [1, 4, 200])
def test_ntile(rows, tiles):
    w = Window.partitionBy("k").orderBy("id")
    expected = rows.withColumn("tile", F.ntile(tiles).over(w))
    same_rows(ntile(rows, ["k"], ["id"], tiles, slices=9), expected)


def test_mode(rows):
    w = Window.partitionBy("k").orderBy(F.desc("n"), "v")
    counts = rows.groupBy("k", "v").agg(F.count("v").alias("n"))
    expected = counts.withColumn("p", F.row_number().over(w)).where("p = 1")
    expected = expected.select("k", F.col("v").alias("mode"), F.col("n").alias("frequency"))
    same_rows(mode(rows, ["k"], "v"), expected)


@pytest.mark.parametrize("sets", ["cube", "rollup", [["k"], ["half"], []]])
def test_summed_sets(rows, sets):
    rows = rows.withColumn("half", F.col("id") % 2)
    raw = {"cube": rows.cube, "rollup": rows.rollup}.get(sets) if isinstance(sets, str) else None
    grouped = (
        raw("k", "half") if raw else rows.groupingSets([[F.col("k")], [F.col("half")], []], "k", "half")
    )
    expected = grouped.agg(
        F.grouping_id().cast("int").alias("level"),
        F.sum("id").alias("s"),
        F.count("v").alias("n"),
    )
    got = summed_sets(rows, ["k", "half"], {"s": F.sum("id"), "n": F.count("v")}, sets=sets)
    same_rows(got, expected)


def test_top_k(rows):
    got = top_k(rows, ["k"], ["v desc", "id"], 3)
    w = Window.partitionBy("k").orderBy(F.desc("v"), "id")
    same_rows(got, rows.withColumn("place", F.row_number().over(w)).where("place <= 3"))


def test_with_group_values(rows):
    w = Window.partitionBy("k")
    expected = rows.withColumns({"n": F.count("v").over(w), "top": F.max("id").over(w)})
    same_rows(with_group_values(rows, ["k"], n=F.count("v"), top=F.max("id")), expected)


def test_exact_sum_takes_negative_and_large_amounts(spark):
    amounts = spark.createDataFrame([(-0.01,), (1e9 + 0.07,), (-5e8 - 0.5,), (None,)], "x double")
    assert str(amounts.agg(exact_sum(cents("x"), 2)).first()[0]) == "499999999.56"
    assert amounts.where("x IS NULL").agg(exact_sum(cents("x"), 2)).first()[0] is None


def test_time_bucket_before_1970(spark):
    times = spark.sql("SELECT TIMESTAMP_NTZ'1969-12-31 23:59:59' AS t UNION ALL SELECT TIMESTAMP_NTZ'1970-01-01'")
    assert sorted(r[0] for r in times.select(time_bucket("t", 60)).collect()) == [-1, 0]


@pytest.mark.parametrize("slices", [None, 25])
def test_sessions(rows, slices):
    w = Window.partitionBy("k").orderBy("t", "id")
    gap = F.timestamp_diff("SECOND", F.lag("t").over(w), F.col("t"))
    expected = (
        rows.withColumn("s", F.when(gap < 120, 0).otherwise(1))
        .withColumn("session", F.sum("s").over(w))
        .drop("s")
    )
    same_rows(sessions(rows, ["k"], "t", 120, tie="id", slices=slices), expected)


@pytest.mark.parametrize("bucket", [100, 1000, 7777])
def test_time_frame(rows, bucket):
    rows = rows.withColumn("t", F.when(F.col("id") % 19 > 0, F.col("t")))
    got = time_frame(
        rows, ["k"], "t", 1000, bucket=bucket,
        n=lambda w: F.count("id").over(w), top=lambda w: F.max("v").over(w),
    )
    seconds = F.timestamp_diff("SECOND", F.expr(START), F.col("t"))
    w = Window.partitionBy("k").orderBy(seconds).rangeBetween(-1000, 0)
    same_rows(got, rows.withColumns({"n": F.count("id").over(w), "top": F.max("v").over(w)}))


@pytest.mark.parametrize("slices", [None, 25])
@pytest.mark.parametrize("preceding", [0, 600])
def test_trailing_sums(rows, preceding, slices):
    # Whole minutes make ties within a key.
    rows = rows.withColumn("t", F.date_trunc("minute", "t").cast("timestamp_ntz"))
    rows = rows.withColumn("a", (F.col("v") * 10).cast("decimal(10,1)"))
    rows = rows.withColumn("t", F.when(F.col("id") % 19 > 0, F.col("t")))
    got = trailing_sums(rows, ["k"], "t", preceding, slices=slices, n="id", s="a")
    seconds = F.timestamp_diff("SECOND", F.expr(START), F.col("t"))
    w = Window.partitionBy("k").orderBy(seconds).rangeBetween(-preceding, 0)
    expected = rows.withColumns({"n": F.sum("id").over(w), "s": F.sum("a").over(w)})
    same_rows(got, expected)


def test_trailing_sums_refuses_doubles(rows):
    with pytest.raises(ValueError):
        trailing_sums(rows, ["k"], "t", 60, s="v")


def test_blocks_are_ordered_and_bounded(rows):
    def describe(block):
        ids = block["id"].tolist()
        assert ids == sorted(ids) and len(ids) <= 20
        return block[["k", "block"]].head(1).assign(n=len(ids), first=ids[0])

    got = apply_in_blocks(
        rows.where("k IS NOT NULL").select("k", "id"), ["k"], ["id"], 20, describe,
        "k long, block long, n long, first long", slices=6,
    )
    w = Window.partitionBy("k").orderBy("id")
    expected = (
        rows.where("k IS NOT NULL")
        .withColumn("block", F.floor((F.row_number().over(w) - 1) / 20))
        .groupBy("k", "block")
        .agg(F.count("*").alias("n"), F.min("id").alias("first"))
    )
    same_rows(got, expected)


def test_elementwise_max(spark):
    data = [(1, [1.0, -2.0]), (1, [None, 7.0]), (2, [3.0, None]), (None, [9.0]), (2, None), (2, []), (3, [None])]
    got = elementwise_max(spark.createDataFrame(data, "k int, e array<float>"), "k", "e")
    found = {(r.k, r.place): r.highest for r in got.collect()}
    assert found == {(1, 0): 1.0, (1, 1): 7.0, (2, 0): 3.0, (2, 1): None, (None, 0): 9.0, (3, 0): None}


def test_luhn_digit_of_nulls_and_negative_numbers(spark):
    numbers = spark.createDataFrame([(7992739871,), (None,), (-5,), (0,)], "n long")
    got = {r.n: r.d for r in numbers.select("n", luhn_digit("n").alias("d")).collect()}
    assert got == {7992739871: 3, None: None, -5: None, 0: 0}
