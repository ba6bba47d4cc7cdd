"""Multi-table business queries: scan, filter, join, aggregate, top-k."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions.columns import cents, mean, total
from weftline.plans.registry import query
from weftline.sources.tables import register_views, table

_NTZ = "timestamp_ntz"


def _revenue():
    return cents("l_extendedprice") * (100 - cents("l_discount"))


# The same exact arithmetic in the SQL statements.
_SQL_REVENUE = "l_extendedprice::DECIMAL(12,2) * (1 - l_discount::DECIMAL(4,2))"


@query(f"""
SELECT l_returnflag, l_linestatus,
       sum(l_quantity::DECIMAL(12,2))::DOUBLE AS sum_qty,
       sum(l_extendedprice::DECIMAL(12,2))::DOUBLE AS sum_base_price,
       sum({_SQL_REVENUE})::DOUBLE AS sum_disc_price,
       sum({_SQL_REVENUE} * (1 + l_tax::DECIMAL(4,2)))::DOUBLE AS sum_charge,
       sum(l_quantity::DECIMAL(12,2))::DOUBLE / count(l_quantity) AS avg_qty,
       sum(l_extendedprice::DECIMAL(12,2))::DOUBLE / count(l_extendedprice) AS avg_price,
       sum(l_discount::DECIMAL(4,2))::DOUBLE / count(l_discount) AS avg_disc,
       count(*) AS count_order
FROM lineitem WHERE l_shipdate <= TIMESTAMP '2001-08-01'
GROUP BY l_returnflag, l_linestatus
""")
def pricing_summary(spark, folder):
    return (
        table(spark, folder, "lineitem")
        .where(F.col("l_shipdate") <= F.lit("2001-08-01").cast(_NTZ))
        .groupBy("l_returnflag", "l_linestatus")
        .agg(
            total(cents("l_quantity"), 2).alias("sum_qty"),
            total(cents("l_extendedprice"), 2).alias("sum_base_price"),
            total(_revenue(), 4).alias("sum_disc_price"),
            total(_revenue() * (100 + cents("l_tax")), 6).alias("sum_charge"),
            mean(cents("l_quantity"), 2).alias("avg_qty"),
            mean(cents("l_extendedprice"), 2).alias("avg_price"),
            mean(cents("l_discount"), 2).alias("avg_disc"),
            F.count(F.lit(1)).alias("count_order"),
        )
    )


@query("""
SELECT l_orderkey, l_linenumber, l_quantity, l_shipdate
FROM lineitem
WHERE l_quantity >= 45 AND l_discount BETWEEN 0.05 AND 0.07
  AND l_shipdate >= TIMESTAMP '1997-01-01' AND l_shipdate < TIMESTAMP '1998-01-01'
""")
def scan_filter_project(spark, folder):
    return (
        table(spark, folder, "lineitem")
        .where(
            (F.col("l_quantity") >= 45)
            & F.col("l_discount").between(0.05, 0.07)
            & (F.col("l_shipdate") >= F.lit("1997-01-01").cast(_NTZ))
            & (F.col("l_shipdate") < F.lit("1998-01-01").cast(_NTZ))
        )
        .select("l_orderkey", "l_linenumber", "l_quantity", "l_shipdate")
    )


@query(f"""
SELECT l_orderkey, sum({_SQL_REVENUE})::DOUBLE AS revenue, o_orderdate, o_orderpriority
FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
WHERE c_mktsegment = 'BUILDING' AND o_orderdate < TIMESTAMP '1998-03-15'
  AND l_shipdate > TIMESTAMP '1998-03-15'
GROUP BY l_orderkey, o_orderdate, o_orderpriority
ORDER BY revenue DESC, o_orderdate, l_orderkey LIMIT 10
""")
def shipping_priority(spark, folder):
    day = F.lit("1998-03-15").cast(_NTZ)
    building = table(spark, folder, "customer").where("c_mktsegment = 'BUILDING'")
    orders = table(spark, folder, "orders").where(F.col("o_orderdate") < day)
    lines = table(spark, folder, "lineitem").where(F.col("l_shipdate") > day)
    return (
        orders.join(building, F.col("o_custkey") == F.col("c_custkey"), "left_semi")
        .join(lines, F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy("l_orderkey", "o_orderdate", "o_orderpriority")
        .agg(total(_revenue(), 4).alias("revenue"))
        .orderBy(F.desc("revenue"), "o_orderdate", "l_orderkey")
        .limit(10)
    )


@query("""
SELECT o_orderpriority, count(*) AS order_count FROM orders
WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1997-04-01'
  AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_shipdate > o_orderdate)
GROUP BY o_orderpriority
""")
def order_priority_check(spark, folder):
    orders = table(spark, folder, "orders").where(
        (F.col("o_orderdate") >= F.lit("1997-01-01").cast(_NTZ))
        & (F.col("o_orderdate") < F.lit("1997-04-01").cast(_NTZ))
    )
    late = (F.col("l_orderkey") == F.col("o_orderkey")) & (
        F.col("l_shipdate") > F.col("o_orderdate")
    )
    return (
        orders.join(table(spark, folder, "lineitem"), late, "left_semi")
        .groupBy("o_orderpriority")
        .agg(F.count(F.lit(1)).alias("order_count"))
    )


@query(f"""
SELECT n_name, sum({_SQL_REVENUE})::DOUBLE AS revenue
FROM customer, orders, lineitem, supplier, nation, region
WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_suppkey = s_suppkey
  AND c_nationkey = s_nationkey AND s_nationkey = n_nationkey
  AND n_regionkey = r_regionkey AND r_name = 'ASIA'
  AND o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1999-01-01'
GROUP BY n_name
""")
def local_supplier_volume(spark, folder):
    asia = (
        table(spark, folder, "nation")
        .join(table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .where("r_name = 'ASIA'")
        .select("n_nationkey", "n_name")
    )
    suppliers = table(spark, folder, "supplier").join(
        asia, F.col("s_nationkey") == F.col("n_nationkey")
    )
    orders = table(spark, folder, "orders").where(
        (F.col("o_orderdate") >= F.lit("1996-01-01").cast(_NTZ))
        & (F.col("o_orderdate") < F.lit("1999-01-01").cast(_NTZ))
    )
    buyers = orders.join(
        table(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey")
    ).select("o_orderkey", "c_nationkey")
    return (
        table(spark, folder, "lineitem")
        .join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(
            buyers,
            (F.col("l_orderkey") == F.col("o_orderkey"))
            & (F.col("s_nationkey") == F.col("c_nationkey")),
        )
        .groupBy("n_name")
        .agg(total(_revenue(), 4).alias("revenue"))
    )


@query("""
SELECT sum(l_extendedprice::DECIMAL(12,2) * l_discount::DECIMAL(4,2))::DOUBLE AS revenue
FROM lineitem
WHERE l_shipdate >= TIMESTAMP '1997-01-01' AND l_shipdate < TIMESTAMP '1998-01-01'
  AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24
""")
def forecast_revenue(spark, folder):
    return (
        table(spark, folder, "lineitem")
        .where(
            (F.col("l_shipdate") >= F.lit("1997-01-01").cast(_NTZ))
            & (F.col("l_shipdate") < F.lit("1998-01-01").cast(_NTZ))
            & F.col("l_discount").between(0.05, 0.07)
            & (F.col("l_quantity") < 24)
        )
        .agg(total(cents("l_extendedprice") * cents("l_discount"), 4).alias("revenue"))
    )


@query(f"""
SELECT s.n_name AS supp_nation, c.n_name AS cust_nation, year(l_shipdate)::INTEGER AS l_year,
       sum({_SQL_REVENUE})::DOUBLE AS revenue
FROM supplier JOIN lineitem ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey
JOIN customer ON c_custkey = o_custkey
JOIN nation s ON s_nationkey = s.n_nationkey JOIN nation c ON c_nationkey = c.n_nationkey
WHERE (s.n_name = 'NATION_3' AND c.n_name = 'NATION_7')
   OR (s.n_name = 'NATION_7' AND c.n_name = 'NATION_3')
GROUP BY ALL
""")
def volume_between_nations(spark, folder):
    pair = table(spark, folder, "nation").where(F.col("n_name").isin("NATION_3", "NATION_7"))
    sellers = table(spark, folder, "supplier").join(
        pair.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("supp_nation")),
        "s_nationkey",
    )
    buyers = table(spark, folder, "customer").join(
        pair.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("cust_nation")),
        "c_nationkey",
    )
    bought = (
        table(spark, folder, "orders")
        .join(buyers, F.col("o_custkey") == F.col("c_custkey"))
        .select("o_orderkey", "cust_nation")
    )
    return (
        table(spark, folder, "lineitem")
        .join(sellers, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(bought, F.col("l_orderkey") == F.col("o_orderkey"))
        .where("supp_nation <> cust_nation")
        .groupBy("supp_nation", "cust_nation", F.year("l_shipdate").alias("l_year"))
        .agg(total(_revenue(), 4).alias("revenue"))
    )


@query(f"""
SELECT c_custkey, c_name, sum({_SQL_REVENUE})::DOUBLE AS revenue, c_acctbal, n_name
FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
JOIN nation ON c_nationkey = n_nationkey
WHERE l_returnflag = 'R' AND o_orderdate >= TIMESTAMP '1996-10-01'
  AND o_orderdate < TIMESTAMP '1997-10-01'
GROUP BY c_custkey, c_name, c_acctbal, n_name
ORDER BY revenue DESC, c_custkey LIMIT 20
""")
def returned_items(spark, folder):
    orders = table(spark, folder, "orders").where(
        (F.col("o_orderdate") >= F.lit("1996-10-01").cast(_NTZ))
        & (F.col("o_orderdate") < F.lit("1997-10-01").cast(_NTZ))
    )
    # Aggregate before the customer and nation columns are joined on.
    per_customer = (
        table(spark, folder, "lineitem")
        .where("l_returnflag = 'R'")
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy("o_custkey")
        .agg(total(_revenue(), 4).alias("revenue"))
    )
    return (
        per_customer.join(
            table(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey")
        )
        .join(table(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .select("c_custkey", "c_name", "revenue", "c_acctbal", "n_name")
        .orderBy(F.desc("revenue"), "c_custkey")
        .limit(20)
    )


@query("""
SELECT c_count, count(*) AS custdist FROM (
  SELECT c_custkey, count(o_orderkey) AS c_count
  FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderpriority <> '1-URGENT'
  GROUP BY c_custkey)
GROUP BY c_count
""")
def customer_distribution(spark, folder):
    counts = (
        table(spark, folder, "orders")
        .where("o_orderpriority <> '1-URGENT'")
        .groupBy("o_custkey")
        .agg(F.count("o_orderkey").alias("n"))
    )
    return (
        table(spark, folder, "customer")
        .join(counts, F.col("c_custkey") == F.col("o_custkey"), "left")
        .select(F.coalesce("n", F.lit(0)).alias("c_count"))
        .groupBy("c_count")
        .agg(F.count(F.lit(1)).alias("custdist"))
    )


@query(f"""
SELECT 100.0 * (sum(CASE WHEN p_type = 'PROMO' THEN {_SQL_REVENUE} ELSE 0 END)::DOUBLE)
       / (sum({_SQL_REVENUE})::DOUBLE) AS promo_revenue
FROM lineitem JOIN part ON l_partkey = p_partkey
WHERE l_shipdate >= TIMESTAMP '1997-09-01' AND l_shipdate < TIMESTAMP '1997-10-01'
""")
def promotion_effect(spark, folder):
    lines = table(spark, folder, "lineitem").where(
        (F.col("l_shipdate") >= F.lit("1997-09-01").cast(_NTZ))
        & (F.col("l_shipdate") < F.lit("1997-10-01").cast(_NTZ))
    )
    promo = F.when(F.col("p_type") == "PROMO", _revenue())
    return lines.join(
        table(spark, folder, "part"), F.col("l_partkey") == F.col("p_partkey")
    ).agg(
        (F.lit(100.0) * F.coalesce(total(promo, 4), F.lit(0.0)) / total(_revenue(), 4)).alias(
            "promo_revenue"
        )
    )


@query("""
SELECT c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice,
       sum(l_quantity::DECIMAL(12,2))::DOUBLE AS sum_qty
FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey
WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey
                     HAVING sum(l_quantity::DECIMAL(12,2)) > 250)
GROUP BY c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice
ORDER BY o_totalprice DESC, o_orderkey LIMIT 100
""")
def large_volume_customers(spark, folder):
    # One aggregate over lineitem serves both the filter and the result.
    large = (
        table(spark, folder, "lineitem")
        .groupBy("l_orderkey")
        .agg(total(cents("l_quantity"), 2).alias("sum_qty"))
        .where("sum_qty > 250")
    )
    return (
        large.join(table(spark, folder, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(table(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .select("c_name", "c_custkey", "o_orderkey", "o_orderdate", "o_totalprice", "sum_qty")
        .orderBy(F.desc("o_totalprice"), "o_orderkey")
        .limit(100)
    )


@query(f"""
SELECT sum({_SQL_REVENUE})::DOUBLE AS revenue FROM lineitem JOIN part ON p_partkey = l_partkey
WHERE (p_brand = 'Brand#12' AND p_size BETWEEN 1 AND 15 AND l_quantity BETWEEN 1 AND 21)
   OR (p_brand = 'Brand#23' AND p_size BETWEEN 1 AND 30 AND l_quantity BETWEEN 10 AND 30)
   OR (p_brand = 'Brand#4' AND p_size BETWEEN 1 AND 45 AND l_quantity BETWEEN 20 AND 40)
""")
def discounted_revenue(spark, folder):
    def choice(brand, size, low, high):
        return (
            (F.col("p_brand") == brand)
            & F.col("p_size").between(1, size)
            & F.col("l_quantity").between(low, high)
        )

    wanted = choice("Brand#12", 15, 1, 21) | choice("Brand#23", 30, 10, 30) | choice("Brand#4", 45, 20, 40)
    return (
        table(spark, folder, "lineitem")
        .join(table(spark, folder, "part"), (F.col("p_partkey") == F.col("l_partkey")) & wanted)
        .agg(total(_revenue(), 4).alias("revenue"))
    )


_SQL_SMALL_QUANTITY = """
SELECT sum(l_extendedprice::DECIMAL(12,2))::DOUBLE / 7.0 AS avg_yearly
FROM lineitem l JOIN part ON p_partkey = l.l_partkey
WHERE p_brand = 'Brand#23' AND l.l_quantity < (
  SELECT 0.5 * avg(l_quantity) FROM lineitem i WHERE i.l_partkey = p_partkey)
"""


@query(_SQL_SMALL_QUANTITY)
def small_quantity_revenue(spark, folder):
    """A correlated scalar subquery: below half the part's mean quantity."""
    parts = table(spark, folder, "part").where("p_brand = 'Brand#23'").select("p_partkey")
    lines = (
        table(spark, folder, "lineitem")
        .join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .select("l_partkey", "l_quantity", "l_extendedprice")
    )
    means = lines.groupBy("l_partkey").agg((0.5 * F.avg("l_quantity")).alias("half_mean"))
    return (
        lines.join(means, "l_partkey")
        .where("l_quantity < half_mean")
        .agg((total(cents("l_extendedprice"), 2) / 7.0).alias("avg_yearly"))
    )


@query("""
SELECT substr(c_name, 10, 1) AS bucket, count(*) AS numcust,
       sum(c_acctbal::DECIMAL(12,2))::DOUBLE AS totacctbal
FROM customer
WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer WHERE c_acctbal > 0)
  AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')
GROUP BY bucket
""")
def idle_rich_customers(spark, folder):
    register_views(spark, folder, ("customer", "orders"))
    return spark.sql("""
        SELECT substr(c_name, 10, 1) AS bucket, count(*) AS numcust,
               CAST(sum(CAST(c_acctbal AS DECIMAL(12,2))) AS DOUBLE) AS totacctbal
        FROM customer
        WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer WHERE c_acctbal > 0)
          AND NOT EXISTS (SELECT 1 FROM orders
                          WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')
        GROUP BY substr(c_name, 10, 1)""")
