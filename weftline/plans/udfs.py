"""Queries over Python functions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from weftline.functions.vectorized import WordsOf, capitalized, elementwise_max, luhn_digit
from weftline.operators.blocks import apply_in_blocks
from weftline.plans.registry import query
from weftline.sources.tables import table


@query("""
WITH digits AS (
  SELECT o_orderkey, list_transform(range(0, length(o_orderkey::VARCHAR)),
    lambda i: (substr(reverse(o_orderkey::VARCHAR), i::INTEGER + 1, 1)::INTEGER)
              * (CASE WHEN i % 2 = 0 THEN 2 ELSE 1 END)) AS d FROM orders)
SELECT o_orderkey,
  ((10 - list_sum(list_transform(d, lambda x: CASE WHEN x > 9 THEN x - 9 ELSE x END)) % 10) % 10)::INTEGER
    AS check_digit
FROM digits
""")
def udf_scalar_pandas(spark, folder):
    return table(spark, folder, "orders").select(
        "o_orderkey", luhn_digit("o_orderkey").alias("check_digit")
    )


@query("SELECT p_partkey, upper(left(p_name, 1)) || lower(substr(p_name, 2)) AS title FROM part")
def udf_scalar_arrow(spark, folder):
    return table(spark, folder, "part").select("p_partkey", capitalized("p_name").alias("title"))


@query("""
SELECT label, place, max(x)::DOUBLE AS highest FROM (
  SELECT label, (generate_subscripts(embedding, 1) - 1)::INTEGER AS place, unnest(embedding) AS x
  FROM embeddings) GROUP BY label, place
""")
def udf_aggregate(spark, folder):
    found = elementwise_max(table(spark, folder, "embeddings"), "label", "embedding")
    return found.withColumn("highest", F.col("highest").cast("double"))


@query("""
SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word,
       generate_subscripts(string_split(p_name, ' '), 1)::INTEGER AS place
FROM part
""")
def udf_table_function(spark, folder):
    parts = table(spark, folder, "part")
    return parts.lateralJoin(WordsOf(F.col("p_name").outer())).select("p_partkey", "word", "place")


@query("""
WITH numbered AS (
  SELECT event_type, event_id, ts, value,
    (row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1) // 250 AS block
  FROM events),
peaks AS (
  SELECT *, max(value) OVER (PARTITION BY event_type, block ORDER BY ts, event_id) AS peak
  FROM numbered)
SELECT event_type, block::BIGINT AS block, count(*) AS n, max(peak - value) AS deepest_fall
FROM peaks GROUP BY event_type, block
""")
def udf_grouped_blocks(spark, folder):
    """The deepest fall from a peak within each 250 consecutive events."""

    def fall(rows: pd.DataFrame) -> pd.DataFrame:
        below = rows["value"].cummax() - rows["value"]
        first = rows.iloc[0]
        return pd.DataFrame(
            {
                "event_type": [first["event_type"]],
                "block": [first["block"]],
                "n": [len(rows)],
                "deepest_fall": [below.max()],
            }
        )

    events = table(spark, folder, "events").select("event_type", "ts", "event_id", "value")
    return apply_in_blocks(
        events, ["event_type"], ["ts", "event_id"], 250, fall,
        "event_type string, block long, n long, deepest_fall double",
    )
