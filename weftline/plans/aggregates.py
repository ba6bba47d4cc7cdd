"""Aggregate queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions.columns import cents, exact_sum, total
from weftline.operators.aggregates import mode, quantiles, summed_sets
from weftline.plans.registry import query
from weftline.plans.sizes import few_rows
from weftline.scratch import written
from weftline.sources.tables import register_views, table


def _few(spark, folder) -> int:
    return few_rows(table(spark, folder, "events"))


def _sql_sets(kind: str) -> str:
    return f"""
SELECT l_returnflag, l_linestatus, year(l_shipdate)::INTEGER AS ship_year,
       grouping_id(l_returnflag, l_linestatus, ship_year)::INTEGER AS level,
       sum(l_quantity::DECIMAL(12,2))::DOUBLE AS quantity, count(*) AS n
FROM lineitem GROUP BY {kind}
"""


def _sets(spark, folder, sets):
    lines = table(spark, folder, "lineitem").withColumn("ship_year", F.year("l_shipdate"))
    return summed_sets(
        lines,
        ["l_returnflag", "l_linestatus", "ship_year"],
        {"quantity": exact_sum(cents("l_quantity"), 2), "n": F.count(F.lit(1))},
        sets=sets,
    ).withColumn("quantity", F.col("quantity").cast("double"))


@query(_sql_sets("CUBE (l_returnflag, l_linestatus, ship_year)"))
def agg_cube(spark, folder):
    return _sets(spark, folder, "cube")


@query(_sql_sets("ROLLUP (l_returnflag, l_linestatus, ship_year)"))
def agg_rollup(spark, folder):
    return _sets(spark, folder, "rollup")


@query(_sql_sets("GROUPING SETS ((l_returnflag, ship_year), (l_linestatus), ())"))
def agg_grouping_sets(spark, folder):
    return _sets(spark, folder, [["l_returnflag", "ship_year"], ["l_linestatus"], []])


@query("""
SELECT l_shipdate, count(DISTINCT l_orderkey) AS orders, count(DISTINCT l_partkey) AS parts,
       count(DISTINCT l_suppkey) AS suppliers, count(*) AS n
FROM lineitem GROUP BY l_shipdate
""")
def agg_distinct(spark, folder):
    """Rows are repeated once a column. Bitmaps of keys would combine better for the parts
    and suppliers, and worse for the orders, whose keys are sparse within a day."""
    return (
        table(spark, folder, "lineitem")
        .groupBy("l_shipdate")
        .agg(
            F.count_distinct("l_orderkey").alias("orders"),
            F.count_distinct("l_partkey").alias("parts"),
            F.count_distinct("l_suppkey").alias("suppliers"),
            F.count(F.lit(1)).alias("n"),
        )
    )


@query("""
SELECT l_returnflag, count(*) FILTER (WHERE l_discount > 0.05) AS discounted,
       sum(l_quantity::DECIMAL(12,2)) FILTER (WHERE l_tax = 0)::DOUBLE AS untaxed_quantity,
       count(DISTINCT CASE WHEN l_quantity = 50 THEN l_suppkey END) AS bulk_suppliers
FROM lineitem GROUP BY l_returnflag
""")
def agg_conditional(spark, folder):
    return (
        table(spark, folder, "lineitem")
        .groupBy("l_returnflag")
        .agg(
            F.count_if(F.col("l_discount") > 0.05).alias("discounted"),
            total(F.when(F.col("l_tax") == 0, cents("l_quantity")), 2).alias("untaxed_quantity"),
            F.count_distinct(F.when(F.col("l_quantity") == 50, F.col("l_suppkey"))).alias(
                "bulk_suppliers"
            ),
        )
    )


@query("""
SELECT o_custkey, count(*) AS orders, max(o_totalprice) AS dearest FROM orders
GROUP BY o_custkey HAVING count(*) >= 15 AND max(o_totalprice) > 400000
""")
def agg_having(spark, folder):
    return (
        table(spark, folder, "orders")
        .groupBy("o_custkey")
        .agg(F.count(F.lit(1)).alias("orders"), F.max("o_totalprice").alias("dearest"))
        .where("orders >= 15 AND dearest > 400000")
    )


@query("""
SELECT event_type, min(value) AS low, max(value) AS high,
       arg_max(event_id, (value, event_id)) AS at_high,
       arg_min(event_id, (value, event_id)) AS at_low,
       min(ts) AS first_ts, max(ts) AS last_ts
FROM events GROUP BY event_type
""")
def agg_extremes(spark, folder):
    place = F.struct("value", "event_id")
    return (
        table(spark, folder, "events")
        .groupBy("event_type")
        .agg(
            F.min("value").alias("low"),
            F.max("value").alias("high"),
            F.max_by("event_id", place).alias("at_high"),
            F.min_by("event_id", place).alias("at_low"),
            F.min("ts").alias("first_ts"),
            F.max("ts").alias("last_ts"),
        )
    )


@query("""
SELECT l_linenumber, bool_and(l_quantity <= 50) AS all_small, bool_or(l_quantity > 49) AS any_full,
       bit_and(l_partkey) AS bits_all, bit_or(l_partkey) AS bits_any, bit_xor(l_partkey) AS bits_odd
FROM lineitem GROUP BY l_linenumber
""")
def agg_bool_bit(spark, folder):
    return (
        table(spark, folder, "lineitem")
        .groupBy("l_linenumber")
        .agg(
            F.bool_and(F.col("l_quantity") <= 50).alias("all_small"),
            F.bool_or(F.col("l_quantity") > 49).alias("any_full"),
            F.bit_and("l_partkey").alias("bits_all"),
            F.bit_or("l_partkey").alias("bits_any"),
            F.bit_xor("l_partkey").alias("bits_odd"),
        )
    )


_MOMENTS = """
WITH m AS (
  SELECT {key} AS k, count(*)::DECIMAL(38,0) AS n,
    sum({x}::DECIMAL(12,2)) AS sx, sum({y}::DECIMAL(12,2)) AS sy,
    sum({x}::DECIMAL(12,2) * {x}::DECIMAL(12,2)) AS sxx,
    sum({y}::DECIMAL(12,2) * {y}::DECIMAL(12,2)) AS syy,
    sum({x}::DECIMAL(12,2) * {y}::DECIMAL(12,2)) AS sxy
  FROM {table} GROUP BY {key}),
d AS (SELECT k, n::DOUBLE AS n, (n::DOUBLE * sxx::DOUBLE - sx::DOUBLE * sx::DOUBLE) AS dxx,
  (n::DOUBLE * syy::DOUBLE - sy::DOUBLE * sy::DOUBLE) AS dyy,
  (n::DOUBLE * sxy::DOUBLE - sx::DOUBLE * sy::DOUBLE) AS dxy FROM m)
SELECT k AS {key}, dxx / (n * (n - 1)) AS var_x, sqrt(dxx / (n * (n - 1))) AS std_x,
  dxy / (n * (n - 1)) AS cov_xy, dxy / sqrt(dxx * dyy) AS corr_xy, dxy / dxx AS slope FROM d
"""


@query(_MOMENTS.format(key="l_returnflag", x="l_quantity", y="l_extendedprice", table="lineitem"))
def agg_moments(spark, folder):
    """Variance, covariance, correlation and slope from exact sums, which do not
    change with the order in which tasks finish."""
    x, y = cents("l_quantity"), cents("l_extendedprice")
    # Products are summed in smaller lanes, which keeps them exact for far more rows.
    sums = {"sx": (x, 2), "sy": (y, 2), "sxx": (x * x, 4, 26), "syy": (y * y, 4, 26), "sxy": (x * y, 4, 26)}
    spread = {
        f"d{a}{b}": F.col("n") * F.col(f"s{a}{b}") - F.col(f"s{a}") * F.col(f"s{b}")
        for a, b in ("xx", "yy", "xy")
    }
    pairs = F.col("n") * (F.col("n") - 1)
    return (
        table(spark, folder, "lineitem")
        .groupBy("l_returnflag")
        .agg(F.count(F.lit(1)).cast("double").alias("n"), *[total(*c).alias(k) for k, c in sums.items()])
        .withColumns(spread)
        .select(
            "l_returnflag",
            (F.col("dxx") / pairs).alias("var_x"),
            F.sqrt(F.col("dxx") / pairs).alias("std_x"),
            (F.col("dxy") / pairs).alias("cov_xy"),
            (F.col("dxy") / F.sqrt(F.col("dxx") * F.col("dyy"))).alias("corr_xy"),
            (F.col("dxy") / F.col("dxx")).alias("slope"),
        )
    )


_SQL_QUANTILES = """
SELECT event_type, round(quantile_cont(value, 0.25), 6) AS p25,
       round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.9), 6) AS p90,
       round(quantile_cont(value, 1.0), 6) AS p100
FROM events GROUP BY event_type
"""
_PROBABILITIES = {"p25": 0.25, "p50": 0.5, "p90": 0.9, "p100": 1.0}


def _quantiles(spark, folder, **options):
    # The engines interpolate with different roundings of the last bit.
    found = quantiles(
        table(spark, folder, "events"), ["event_type"], "value", _PROBABILITIES, **options
    )
    return found.withColumns({p: F.round(p, 6) for p in _PROBABILITIES})


@query(_SQL_QUANTILES)
def agg_quantiles(spark, folder):
    return _quantiles(spark, folder)


@query(_SQL_QUANTILES)
def agg_quantiles_sliced(spark, folder):
    return _quantiles(spark, folder, rows_per_slice=_few(spark, folder))


@query("SELECT median(o_totalprice) AS median_price FROM orders")
def agg_median(spark, folder):
    orders = table(spark, folder, "orders")
    return quantiles(orders, [], "o_totalprice", {"median_price": 0.5})


@query("""
SELECT l_suppkey, l_quantity AS mode, n AS frequency FROM (
  SELECT l_suppkey, l_quantity, count(*) AS n,
         row_number() OVER (PARTITION BY l_suppkey ORDER BY count(*) DESC, l_quantity) AS place
  FROM lineitem GROUP BY l_suppkey, l_quantity) WHERE place = 1
""")
def agg_mode(spark, folder):
    return mode(table(spark, folder, "lineitem"), ["l_suppkey"], "l_quantity")


@query("""
SELECT year(o_orderdate)::INTEGER AS order_year,
  sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice::DECIMAL(12,2) END)::DOUBLE AS f_price,
  sum(CASE WHEN o_orderstatus = 'O' THEN o_totalprice::DECIMAL(12,2) END)::DOUBLE AS o_price,
  sum(CASE WHEN o_orderstatus = 'P' THEN o_totalprice::DECIMAL(12,2) END)::DOUBLE AS p_price
FROM orders GROUP BY order_year
""")
def agg_pivot(spark, folder):
    # Naming the values spares the job that would look for them.
    return (
        table(spark, folder, "orders")
        .groupBy(F.year("o_orderdate").alias("order_year"))
        .pivot("o_orderstatus", ["F", "O", "P"])
        .agg(total(cents("o_totalprice"), 2))
        .toDF("order_year", "f_price", "o_price", "p_price")
    )


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, measure, amount FROM (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_discount, l_tax FROM lineitem)
UNPIVOT (amount FOR measure IN (l_quantity, l_discount, l_tax))
""")
def agg_unpivot(spark, folder):
    return table(spark, folder, "lineitem").unpivot(
        ["l_orderkey", "l_linenumber", "l_partkey"],
        ["l_quantity", "l_discount", "l_tax"],
        "measure",
        "amount",
    )


@query("""
SELECT event_type, (least(floor(value / 10), 20))::BIGINT AS band, count(*) AS n
FROM events GROUP BY ALL
""")
def agg_histogram(spark, folder):
    band = F.least(F.floor(F.col("value") / 10), F.lit(20)).cast("bigint")
    return (
        table(spark, folder, "events")
        .groupBy("event_type", band.alias("band"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query("""
SELECT p_brand, sum(l_quantity::DECIMAL(12,2))::DOUBLE AS quantity
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand
""")
def agg_before_join(spark, folder):
    """Lines are summed per part first; the join then sees one row per part."""
    per_part = (
        table(spark, folder, "lineitem")
        .groupBy("l_partkey")
        .agg(exact_sum(cents("l_quantity"), 2).alias("q"))
    )
    return (
        per_part.join(table(spark, folder, "part"), F.col("l_partkey") == F.col("p_partkey"))
        .groupBy("p_brand")
        .agg(F.sum("q").cast("double").alias("quantity"))
    )


@query("""
WITH RECURSIVE steps AS (
  SELECT 0 AS level, min(o_orderdate) AS from_date FROM orders
  UNION ALL SELECT level + 1, from_date + INTERVAL 1 YEAR FROM steps
  WHERE from_date + INTERVAL 1 YEAR <= (SELECT max(o_orderdate) FROM orders))
SELECT level, from_date, count(o_orderkey) AS orders FROM steps
LEFT JOIN orders ON o_orderdate >= from_date AND o_orderdate < from_date + INTERVAL 1 YEAR
GROUP BY level, from_date
""")
def agg_recursive_calendar(spark, folder):
    """A recursive query makes the calendar; orders find their year by number."""
    register_views(spark, folder, ("orders",))
    calendar = spark.sql("""
        WITH RECURSIVE steps(level, from_date, last_date) AS (
          SELECT 0, min(o_orderdate), max(o_orderdate) FROM orders
          UNION ALL SELECT level + 1, from_date + INTERVAL 1 YEAR, last_date FROM steps
          WHERE from_date + INTERVAL 1 YEAR <= last_date)
        SELECT level, from_date FROM steps""")
    daily = (
        table(spark, folder, "orders")
        .groupBy("o_orderdate")
        .agg(F.count("o_orderkey").alias("n"))
    )
    # Whole years since the first date give each date its level; years start on one day.
    first = table(spark, folder, "orders").agg(F.min("o_orderdate")).first()[0]
    months = F.floor(F.months_between("o_orderdate", F.lit(first)) + F.lit(1e-9))
    daily = daily.withColumn("year_number", F.floor(months / 12).cast("int"))
    return (
        calendar.join(daily, F.col("level") == F.col("year_number"), "left")
        .groupBy("level", "from_date")
        .agg(F.coalesce(F.sum("n"), F.lit(0)).alias("orders"))
    )


@query()
def agg_approx_distinct(spark, folder):
    return (
        table(spark, folder, "lineitem")
        .groupBy("l_returnflag")
        .agg(F.approx_count_distinct("l_orderkey", 0.02).alias("orders"))
    )


@query()
def agg_approx_quantiles(spark, folder):
    return (
        table(spark, folder, "events")
        .groupBy("event_type")
        .agg(F.percentile_approx("value", [0.25, 0.5, 0.9], 10_000).alias("q"))
        .select("event_type", *[F.col("q")[i].alias(n) for i, n in enumerate(("p25", "p50", "p90"))])
    )


@query()
def agg_distinct_sketch(spark, folder):
    """Sketches per day that merge into any longer period."""
    daily = (
        table(spark, folder, "events")
        .groupBy(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day"), "event_type")
        .agg(F.hll_sketch_agg("user_id", 14).alias("sketch"))
    )
    return daily.groupBy("event_type").agg(
        F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("users")
    )


@query()
def agg_quantile_sketch(spark, folder):
    sketched = (
        table(spark, folder, "events")
        .groupBy("event_type")
        .agg(F.kll_sketch_agg_double("value").alias("sketch"))
    )
    return sketched.select(
        "event_type",
        F.kll_sketch_get_quantile_double("sketch", F.lit(0.5)).alias("median"),
        F.kll_sketch_get_n_double("sketch").alias("n"),
    )


@query()
def agg_count_min(spark, folder):
    """A count-min sketch of the users per event type, in its binary form."""
    return (
        table(spark, folder, "events")
        .groupBy("event_type")
        .agg(
            F.count_min_sketch("user_id", F.lit(0.01), F.lit(0.99), F.lit(7)).alias("sketch"),
            F.count(F.lit(1)).alias("n"),
        )
    )


@query("""
SELECT event_type, count(*) AS n, true AS distinct_close, true AS median_close, true AS all_counted
FROM events GROUP BY event_type
""")
def agg_sketches_within_bounds(spark, folder):
    """What the sketches promise, checked on the rows that they summarise: distinct users
    within a tenth, a median whose rank is within 0.03 of a half, and every row counted."""
    events = table(spark, folder, "events")
    sketched = events.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_distinct("user_id").alias("users"),
        F.approx_count_distinct("user_id", 0.02).alias("about_users"),
        F.percentile_approx("value", 0.5, 10_000).alias("about_median"),
        F.kll_sketch_agg_double("value").alias("sketch"),
    )
    found = written(
        sketched.select(
            "event_type", "n", "about_median",
            (F.abs(F.col("about_users") - F.col("users")) <= 0.1 * F.col("users")).alias("distinct_close"),
            (F.kll_sketch_get_n_double("sketch") == F.col("n")).alias("all_counted"),
        ),
        "sketches",
    )
    below = (F.col("value") <= F.col("about_median")).cast("int")
    return (
        events.join(found, "event_type")
        .groupBy("event_type", "n", "distinct_close", "all_counted")
        .agg((F.abs(F.avg(below) - 0.5) <= 0.03).alias("median_close"))
    )
