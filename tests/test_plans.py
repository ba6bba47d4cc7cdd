"""Physical plans: pushdown, pruning, and no exchange or nested loop in excess."""

import re

import pytest

import __spark_entry__ as spark_entry

QUERIES = spark_entry.queries()

def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "name",
    [n for n in sorted(QUERIES) if not re.match("stream_|source_|op\\d|pipeline", n)],
)
def test_no_pairwise_join(spark, small, name):
    text = plan(QUERIES[name](spark, small))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_filter_and_columns_reach_the_scan(spark, small):
    text = plan(QUERIES["scan_filter_project"](spark, small))
    pushed = re.search(r"PushedFilters: \[([^\]]*)\]", text).group(1)
    assert "GreaterThanOrEqual(l_quantity,45.0)" in pushed and "l_shipdate" in pushed
    schema = re.search(r"ReadSchema: struct<([^>]*)>", text).group(1)
    assert "l_extendedprice" not in schema and "l_tax" not in schema


def test_partition_filter_prunes_folders(spark, small):
    text = plan(QUERIES["source_partitioned"](spark, small))
    assert re.search(r"PartitionFilters: \[[^\]]*order_year", text)


def test_bucketed_join_has_no_exchange(spark, small):
    assert "Exchange" not in plan(QUERIES["source_bucketed_join"](spark, small))


def test_sessions_exchange_once(spark, small):
    assert plan(QUERIES["sessions_numbered"](spark, small)).count("Exchange hashpartitioning") == 1


def test_as_of_exchanges_once(spark, small):
    assert plan(QUERIES["join_as_of"](spark, small)).count("Exchange hashpartitioning") == 1


def test_top_k_cuts_before_the_exchange(spark, small):
    text = plan(QUERIES["top_k_per_group"](spark, small))
    assert text.count("WindowGroupLimit") == 2


def test_group_share_keeps_rows_in_place(spark, small):
    text = plan(QUERIES["window_share_of_group"](spark, small))
    assert "BroadcastHashJoin" in text and "Exchange hashpartitioning" not in text


def test_cube_repeats_groups_not_rows(spark, small):
    text = plan(QUERIES["agg_cube"](spark, small))
    assert text.index("Expand") < text.index("Exchange hashpartitioning", text.index("Expand"))
