"""Approximate aggregates against exact ones, within their stated errors."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as spark_entry
from weftline.sources.tables import table

QUERIES = spark_entry.queries()


def by_key(frame, key):
    return {r[key]: r for r in frame.collect()}


def test_approx_distinct(spark, medium):
    lines = table(spark, medium, "lineitem")
    exact = by_key(lines.groupBy("l_returnflag").agg(F.count_distinct("l_orderkey").alias("n")), "l_returnflag")
    got = by_key(QUERIES["agg_approx_distinct"](spark, medium), "l_returnflag")
    assert set(got) == set(exact)
    for key in got:  # five standard errors
        assert got[key].orders == pytest.approx(exact[key].n, rel=0.1)


def test_distinct_sketches_merge_over_days(spark, medium):
    events = table(spark, medium, "events")
    exact = by_key(events.groupBy("event_type").agg(F.count_distinct("user_id").alias("n")), "event_type")
    got = by_key(QUERIES["agg_distinct_sketch"](spark, medium), "event_type")
    assert {k: r.users for k, r in got.items()} == {k: r.n for k, r in exact.items()}


def ranks(spark, folder, column):
    """The share of values at or below each type's reported value."""
    events = table(spark, folder, "events")
    found = QUERIES["agg_approx_quantiles" if column != "median" else "agg_quantile_sketch"](spark, folder)
    joined = events.join(found, "event_type")
    return [
        r.share
        for r in joined.groupBy("event_type").agg(F.avg((F.col("value") <= F.col(column)).cast("int")).alias("share")).collect()
    ]


@pytest.mark.parametrize("column, wanted", [("p25", 0.25), ("p50", 0.5), ("p90", 0.9), ("median", 0.5)])
def test_quantiles_have_the_wanted_rank(spark, medium, column, wanted):
    for share in ranks(spark, medium, column):
        assert share == pytest.approx(wanted, abs=0.03)


def test_count_min_counts_every_row(spark, medium):
    got = by_key(QUERIES["agg_count_min"](spark, medium), "event_type")
    exact = by_key(table(spark, medium, "events").groupBy("event_type").count(), "event_type")
    for key, row in got.items():
        # The serialised sketch holds its version, then the total it has counted.
        assert int.from_bytes(row.sketch[4:12], "big") == exact[key]["count"] == row.n
