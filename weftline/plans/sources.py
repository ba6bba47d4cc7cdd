"""Source and sink queries: what is written must read back unchanged."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions.columns import cents, total
from weftline.plans.registry import query
from weftline.scratch import fresh_path
from weftline.sources.files import bucketed, read_files, round_trip, write_files
from weftline.sources.ltsv import LtsvSource
from weftline.sources.tables import table

_ORDERS = "SELECT * FROM orders"


@query(_ORDERS)
def source_csv(spark, folder):
    return round_trip(table(spark, folder, "orders"), "csv")


@query("SELECT * FROM events")
def source_json(spark, folder):
    return round_trip(table(spark, folder, "events"), "json")


@query(_ORDERS)
def source_xml(spark, folder):
    return round_trip(table(spark, folder, "orders"), "xml")


@query(_ORDERS)
def source_orc(spark, folder):
    return round_trip(table(spark, folder, "orders"), "orc")


_DOCUMENTS = "SELECT * FROM documents"


@query(_DOCUMENTS)
def source_parquet(spark, folder):
    return round_trip(table(spark, folder, "documents"), "parquet")


@query(_DOCUMENTS)
def source_csv_texts(spark, folder):
    """Texts with line ends, quotes and blanks at their ends."""
    return round_trip(table(spark, folder, "documents"), "csv")


@query(_DOCUMENTS)
def source_json_texts(spark, folder):
    return round_trip(table(spark, folder, "documents"), "json")


@query(_DOCUMENTS)
def source_xml_texts(spark, folder):
    return round_trip(table(spark, folder, "documents"), "xml")


@query(_DOCUMENTS)
def source_orc_texts(spark, folder):
    return round_trip(table(spark, folder, "documents"), "orc")


@query("""
SELECT o_orderpriority, year(o_orderdate)::INTEGER AS order_year, count(*) AS n,
       sum(o_totalprice::DECIMAL(12,2))::DOUBLE AS price
FROM orders WHERE year(o_orderdate) IN (1997, 1999) GROUP BY ALL
""")
def source_partitioned(spark, folder):
    """A filter on the partition column reads only the folders it names."""
    orders = table(spark, folder, "orders").withColumn("order_year", F.year("o_orderdate"))
    path = fresh_path(spark, "by-year")
    write_files(orders, path, "parquet", partition_by=["order_year"])
    return (
        read_files(spark, path, "parquet", orders.schema)
        .where("order_year IN (1997, 1999)")
        .groupBy("o_orderpriority", "order_year")
        .agg(F.count(F.lit(1)).alias("n"), total(cents("o_totalprice"), 2).alias("price"))
    )


@query("""
SELECT o_orderkey, o_orderpriority, count(*) AS lines,
       sum(l_extendedprice::DECIMAL(12,2))::DOUBLE AS price
FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey, o_orderpriority
""")
def source_bucketed_join(spark, folder):
    """Both tables are bucketed by order, so join and grouping need no exchange."""
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderpriority")
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_extendedprice")
    stored_orders = bucketed(orders, ["o_orderkey"], buckets)
    stored_lines = bucketed(lines, ["l_orderkey"], buckets)
    return (
        stored_orders.hint("merge")
        .join(stored_lines, F.col("o_orderkey") == F.col("l_orderkey"))
        .groupBy("o_orderkey", "o_orderpriority")
        .agg(F.count(F.lit(1)).alias("lines"), total(cents("l_extendedprice"), 2).alias("price"))
    )


@query("SELECT conv_id, turn, role, text FROM conversations")
def source_connector(spark, folder):
    """The project's own data source, written and read back in byte ranges."""
    spark.dataSource.register(LtsvSource)
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    path = fresh_path(spark, "ltsv")
    turns.write.format("ltsv").mode("append").save(path)
    return (
        spark.read.format("ltsv")
        .schema(turns.schema)
        .option("splitBytes", str(1 << 22))
        .load(path)
    )
