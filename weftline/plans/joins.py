"""Join queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions.columns import cents, total
from weftline.operators.joins import (
    as_of_join,
    count_below,
    full_outer_join,
    interval_join,
    range_join,
    range_join_any,
)
from weftline.plans.registry import query
from weftline.plans.sizes import few_rows
from weftline.sources.tables import register_views, table


@query("""
SELECT o_orderkey, c_custkey, c_mktsegment, n_name
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
""")
def join_inner(spark, folder):
    return (
        table(spark, folder, "orders")
        .join(table(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(table(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .select("o_orderkey", "c_custkey", "c_mktsegment", "n_name")
    )


@query("""
SELECT o_orderkey, o_orderpriority, l_linenumber, l_quantity
FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey
""")
def join_left(spark, folder):
    lines = table(spark, folder, "lineitem")
    return (
        table(spark, folder, "orders")
        .join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
        .select("o_orderkey", "o_orderpriority", "l_linenumber", "l_quantity")
    )


@query("""
SELECT l_orderkey, l_linenumber, o_orderkey, o_orderstatus
FROM lineitem RIGHT JOIN orders ON o_orderkey = l_orderkey
""")
def join_right(spark, folder):
    return (
        table(spark, folder, "lineitem")
        .join(table(spark, folder, "orders"), F.col("o_orderkey") == F.col("l_orderkey"), "right")
        .select("l_orderkey", "l_linenumber", "o_orderkey", "o_orderstatus")
    )


@query("""
SELECT c_custkey, c_name, s_suppkey, s_name
FROM customer FULL JOIN supplier ON c_custkey = s_suppkey + 50
""")
def join_full(spark, folder):
    suppliers = table(spark, folder, "supplier").withColumn("peer", F.col("s_suppkey") + 50)
    return full_outer_join(table(spark, folder, "customer"), suppliers, [("c_custkey", "peer")]).select(
        "c_custkey", "c_name", "s_suppkey", "s_name"
    )


@query("""
SELECT o_orderkey, o_totalprice FROM orders
WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')
""")
def join_semi(spark, folder):
    returned = table(spark, folder, "lineitem").where("l_returnflag = 'R'")
    return (
        table(spark, folder, "orders")
        .join(returned, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi")
        .select("o_orderkey", "o_totalprice")
    )


@query("""
SELECT o_orderkey, o_totalprice FROM orders
WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)
""")
def join_anti(spark, folder):
    return (
        table(spark, folder, "orders")
        .join(
            table(spark, folder, "lineitem"),
            F.col("o_orderkey") == F.col("l_orderkey"),
            "left_anti",
        )
        .select("o_orderkey", "o_totalprice")
    )


@query("""
SELECT c_custkey, c_acctbal,
       (SELECT count(*) FROM supplier WHERE s_acctbal < c_acctbal) AS poorer_suppliers
FROM customer
""")
def join_theta_count(spark, folder):
    """An inequality join that is counted, without forming its pairs."""
    return count_below(
        table(spark, folder, "customer").select("c_custkey", "c_acctbal"),
        table(spark, folder, "supplier"),
        "c_acctbal",
        "s_acctbal",
        "poorer_suppliers",
    )


@query("""
SELECT c_custkey, c_acctbal,
       (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_totalprice < 20 * c_acctbal)
         AS affordable_orders
FROM customer
""")
def join_theta_count_by_key(spark, folder):
    """The same within each customer."""
    customers = table(spark, folder, "customer").select(
        "c_custkey", "c_acctbal", (20 * F.col("c_acctbal")).alias("budget")
    )
    orders = table(spark, folder, "orders").select(
        F.col("o_custkey").alias("c_custkey"), "o_totalprice"
    )
    return count_below(
        customers, orders, "budget", "o_totalprice", "affordable_orders", keys=["c_custkey"]
    ).drop("budget")


@query("""
WITH width AS (SELECT 4000.0::DOUBLE / count(*) AS w FROM supplier)
SELECT c_custkey, c_acctbal, s_suppkey, s_acctbal FROM customer, width
JOIN supplier ON c_acctbal BETWEEN s_acctbal - w AND s_acctbal + w
""")
def join_range(spark, folder):
    """The denser the suppliers, the narrower the range, so a customer meets about as many
    at any size of the tables."""
    suppliers = table(spark, folder, "supplier")
    width = 4000.0 / max(suppliers.count(), 1)
    suppliers = suppliers.select(
        "s_suppkey",
        "s_acctbal",
        (F.col("s_acctbal") - F.lit(width)).alias("low"),
        (F.col("s_acctbal") + F.lit(width)).alias("high"),
    )
    customers = table(spark, folder, "customer").select("c_custkey", "c_acctbal")
    return range_join(customers, suppliers, "c_acctbal", "low", "high", 2 * width).drop("low", "high")


@query("""
WITH width AS (SELECT 2000.0::DOUBLE / count(*) AS w FROM supplier)
SELECT c_custkey, c_acctbal, s_suppkey, s_acctbal FROM supplier, width
JOIN customer ON s_acctbal BETWEEN c_acctbal AND c_acctbal + w * CASE c_custkey % 100 WHEN 0 THEN 200 WHEN 1 THEN 20 ELSE 1 END
""")
def join_range_any_width(spark, folder):
    """Ranges of widths far apart: one in a hundred is two hundred times as wide as most."""
    suppliers = table(spark, folder, "supplier").select("s_suppkey", "s_acctbal")
    width = 2000.0 / max(suppliers.count(), 1)
    wide = F.when(F.col("c_custkey") % 100 == 0, 200.0).when(F.col("c_custkey") % 100 == 1, 20.0).otherwise(1.0)
    customers = table(spark, folder, "customer").select(
        "c_custkey", "c_acctbal", (F.col("c_acctbal") + F.lit(width) * wide).alias("upto")
    )
    ranges = customers.withColumnRenamed("c_acctbal", "from")
    pairs = range_join_any(suppliers, ranges, "s_acctbal", "from", "upto")
    return pairs.select("c_custkey", F.col("from").alias("c_acctbal"), "s_suppkey", "s_acctbal")


@query("""
SELECT a.event_id AS view_id, b.event_id AS purchase_id, a.user_id
FROM events a JOIN events b ON a.user_id = b.user_id
WHERE a.event_type = 'view' AND b.event_type = 'purchase'
  AND b.ts BETWEEN a.ts AND a.ts + INTERVAL 1 HOUR
""")
def join_interval(spark, folder):
    events = table(spark, folder, "events")
    views = events.where("event_type = 'view'").select(
        F.col("event_id").alias("view_id"), "user_id", F.col("ts").alias("view_ts")
    )
    purchases = events.where("event_type = 'purchase'").select(
        F.col("event_id").alias("purchase_id"), "user_id", F.col("ts").alias("purchase_ts")
    )
    return interval_join(views, purchases, ["user_id"], "view_ts", "purchase_ts", 3600).select(
        "view_id", "purchase_id", "user_id"
    )


_AS_OF = """
SELECT l.event_id, l.user_id, l.ts, r.event_id AS view_id, r.ts AS matched_ts, r.value AS view_value
FROM events l ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') r
  ON l.user_id = r.user_id AND l.ts >= r.ts
"""


def _as_of(spark, folder, **options):
    events = table(spark, folder, "events")
    views = events.where("event_type = 'view'").select(
        "user_id", "ts", F.col("event_id").alias("view_id"), F.col("value").alias("view_value")
    )
    return as_of_join(
        events.select("event_id", "user_id", "ts"), views, ["user_id"], "ts",
        ties=["view_id"], **options,
    )


@query(_AS_OF)
def join_as_of(spark, folder):
    return _as_of(spark, folder)


@query(_AS_OF)
def join_as_of_sliced(spark, folder):
    """The same join with slices small enough for many keys to span tasks."""
    return _as_of(spark, folder, rows_per_slice=few_rows(table(spark, folder, "events")))


@query("""
SELECT l.event_id, l.user_id, l.ts,
  CASE WHEN l.ts - r.ts <= INTERVAL 2 HOUR THEN r.event_id END AS view_id,
  CASE WHEN l.ts - r.ts <= INTERVAL 2 HOUR THEN r.ts END AS matched_ts,
  CASE WHEN l.ts - r.ts <= INTERVAL 2 HOUR THEN r.value END AS view_value
FROM events l ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') r
  ON l.user_id = r.user_id AND l.ts >= r.ts
""")
def join_as_of_tolerance(spark, folder):
    return _as_of(spark, folder, tolerance=7200)


@query("""
SELECT c.c_custkey, p.c_custkey AS peer FROM customer c JOIN customer p
ON c.c_nationkey = p.c_nationkey AND c.c_mktsegment = p.c_mktsegment
AND p.c_custkey = c.c_custkey + 25
""")
def join_self(spark, folder):
    customers = table(spark, folder, "customer")
    mine = customers.select("c_custkey", "c_nationkey", "c_mktsegment")
    theirs = customers.select(
        F.col("c_custkey").alias("peer"),
        F.col("c_nationkey").alias("peer_nation"),
        F.col("c_mktsegment").alias("peer_segment"),
    )
    # The exact key is the join key; nation and segment filter what it finds.
    return mine.join(
        theirs,
        (F.col("peer") == F.col("c_custkey") + 25)
        & (F.col("peer_nation") == F.col("c_nationkey"))
        & (F.col("peer_segment") == F.col("c_mktsegment")),
    ).select("c_custkey", "peer")


@query("""
SELECT o_orderkey, o_totalprice,
  (SELECT sum(l_extendedprice::DECIMAL(12,2))::DOUBLE FROM lineitem WHERE l_orderkey = o_orderkey)
    AS lines_price
FROM orders
""")
def subquery_scalar(spark, folder):
    orders = table(spark, folder, "orders")
    lines = table(spark, folder, "lineitem")
    price = (
        lines.where(F.col("l_orderkey") == F.col("o_orderkey").outer())
        .select(total(cents("l_extendedprice"), 2))
        .scalar()
    )
    return orders.select("o_orderkey", "o_totalprice", price.alias("lines_price"))


@query("""
SELECT s_suppkey, s_name FROM supplier
WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_quantity = 50 AND l_discount = 0.1)
  AND s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_quantity = 1 AND l_discount = 0.1
                        AND l_tax = 0.08)
""")
def subquery_exists_not_in(spark, folder):
    lines = table(spark, folder, "lineitem")
    mine = lines.where(
        (F.col("l_suppkey") == F.col("s_suppkey").outer())
        & (F.col("l_quantity") == 50)
        & (F.col("l_discount") == 0.1)
    )
    barred = lines.where("l_quantity = 1 AND l_discount = 0.1 AND l_tax = 0.08")
    # NOT IN over a column without nulls is an anti join on equality.
    return (
        table(spark, folder, "supplier")
        .where(mine.exists())
        .join(
            barred.where("l_suppkey IS NOT NULL"),
            F.col("s_suppkey") == F.col("l_suppkey"),
            "left_anti",
        )
        .select("s_suppkey", "s_name")
    )


@query("""
SELECT n_name, lines, cheapest, dearest FROM nation, LATERAL (
  SELECT count(*) AS lines, min(s_acctbal) AS cheapest, max(s_acctbal) AS dearest
  FROM supplier WHERE s_nationkey = n_nationkey)
""")
def join_lateral(spark, folder):
    register_views(spark, folder, ("nation", "supplier"))
    return spark.sql("""
        SELECT n_name, lines, cheapest, dearest FROM nation, LATERAL (
          SELECT count(*) AS lines, min(s_acctbal) AS cheapest, max(s_acctbal) AS dearest
          FROM supplier WHERE s_nationkey = n_nationkey)""")
