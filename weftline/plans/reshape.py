"""Set operations and the string, date, array and JSON functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions.columns import cents, epoch_micros, total
from weftline.plans.registry import query
from weftline.sources.tables import table


def _nations(spark, folder):
    customers = table(spark, folder, "customer").select(F.col("c_nationkey").alias("nationkey"))
    suppliers = table(spark, folder, "supplier").select(F.col("s_nationkey").alias("nationkey"))
    return customers, suppliers


def _sql_sets(word: str) -> str:
    return f"""
SELECT c_nationkey AS nationkey FROM customer {word} SELECT s_nationkey FROM supplier
"""


@query(_sql_sets("UNION ALL"))
def set_union_all(spark, folder):
    customers, suppliers = _nations(spark, folder)
    return customers.unionByName(suppliers)


@query(_sql_sets("UNION"))
def set_union(spark, folder):
    customers, suppliers = _nations(spark, folder)
    return customers.unionByName(suppliers).distinct()


@query(_sql_sets("INTERSECT"))
def set_intersect(spark, folder):
    customers, suppliers = _nations(spark, folder)
    return customers.intersect(suppliers)


@query(_sql_sets("INTERSECT ALL"))
def set_intersect_all(spark, folder):
    customers, suppliers = _nations(spark, folder)
    return customers.intersectAll(suppliers)


@query("""
SELECT o_custkey AS custkey FROM orders WHERE o_orderpriority = '1-URGENT'
EXCEPT SELECT o_custkey FROM orders WHERE o_orderpriority = '5-LOW'
""")
def set_except(spark, folder):
    orders = table(spark, folder, "orders")
    urgent = orders.where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("custkey"))
    low = orders.where("o_orderpriority = '5-LOW'").select(F.col("o_custkey").alias("custkey"))
    return urgent.subtract(low)


@query(_sql_sets("EXCEPT ALL"))
def set_except_all(spark, folder):
    customers, suppliers = _nations(spark, folder)
    return customers.exceptAll(suppliers)


@query("SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem")
def set_distinct(spark, folder):
    return table(spark, folder, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber").distinct()


@query("""
SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, count(*) AS copies
FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1
""")
def set_repeated_keys(spark, folder):
    return (
        table(spark, folder, "lineitem")
        .groupBy("l_orderkey", "l_linenumber")
        .agg(F.min("l_partkey").alias("l_partkey"), F.count(F.lit(1)).alias("copies"))
        .where("copies > 1")
    )


@query("""
SELECT p_partkey, upper(p_name) AS shouted, lower(p_brand) AS brand, length(p_name)::INTEGER AS name_length,
  substr(p_name, 2, 4) AS middle, split_part(p_name, ' ', 2) AS second_word,
  replace(p_name, ' ', '_') AS joined, reverse(p_type) AS backwards,
  lpad(p_size::VARCHAR, 4, '0') AS padded, rpad(p_type, 10, '.') AS filled,
  trim('  ' || p_type || ' ') AS trimmed, p_name || '/' || p_brand AS both,
  strpos(p_name, 'e')::INTEGER AS at_e, p_name LIKE '%widget' AS is_widget,
  starts_with(p_brand, 'Brand#1') AS brand_one, left(p_type, 3) AS head, right(p_type, 3) AS tail,
  repeat(substr(p_type, 1, 1), 3) AS thrice, translate(p_name, 'aeiou', 'AEIOU') AS vowels,
  ascii(p_name)::INTEGER AS first_code, md5(p_name) AS digest,
  levenshtein(p_name, p_type)::INTEGER AS distance
FROM part
""")
def functions_string(spark, folder):
    name, kind = F.col("p_name"), F.col("p_type")
    return table(spark, folder, "part").select(
        "p_partkey",
        F.upper(name).alias("shouted"),
        F.lower("p_brand").alias("brand"),
        F.length(name).alias("name_length"),
        F.substring(name, 2, 4).alias("middle"),
        F.split_part(name, F.lit(" "), F.lit(2)).alias("second_word"),
        F.replace(name, F.lit(" "), F.lit("_")).alias("joined"),
        F.reverse(kind).alias("backwards"),
        F.lpad(F.col("p_size").cast("string"), 4, "0").alias("padded"),
        F.rpad(kind, 10, ".").alias("filled"),
        F.trim(F.concat(F.lit("  "), kind, F.lit(" "))).alias("trimmed"),
        F.concat_ws("/", name, "p_brand").alias("both"),
        F.instr(name, "e").alias("at_e"),
        name.like("%widget").alias("is_widget"),
        F.col("p_brand").startswith("Brand#1").alias("brand_one"),
        F.left(kind, F.lit(3)).alias("head"),
        F.right(kind, F.lit(3)).alias("tail"),
        F.repeat(F.substring(kind, 1, 1), 3).alias("thrice"),
        F.translate(name, "aeiou", "AEIOU").alias("vowels"),
        F.ascii(name).alias("first_code"),
        F.md5(name).alias("digest"),
        F.levenshtein(name, kind).alias("distance"),
    )


@query(r"""
SELECT doc_id, regexp_extract(text, '([A-Za-z]+)ing\b', 1) AS first_ing,
  regexp_replace(text, '[^a-z]+', '', 'g') AS letters,
  regexp_matches(text, '\d{3}') AS has_number,
  len(regexp_extract_all(text, '[A-Za-z]+'))::INTEGER AS words,
  (length(text) - length(replace(text, chr(10), '')))::INTEGER AS line_breaks,
  sha256(text) AS digest
FROM documents
""")
def functions_regex(spark, folder):
    text = F.col("text")
    return table(spark, folder, "documents").select(
        "doc_id",
        F.regexp_extract(text, r"([A-Za-z]+)ing\b", 1).alias("first_ing"),
        F.regexp_replace(text, "[^a-z]+", "").alias("letters"),
        F.regexp_like(text, F.lit(r"\d{3}")).alias("has_number"),
        F.regexp_count(text, F.lit("[A-Za-z]+")).alias("words"),
        (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))).alias("line_breaks"),
        F.sha2(text, 256).alias("digest"),
    )


@query("""
SELECT word, count(*) AS n, count(DISTINCT doc_id) AS docs FROM (
  SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents)
GROUP BY word
""")
def functions_word_count(spark, folder):
    """One exchange of counts combined before it. A document is one row (``doc_id`` is
    unique), so the documents of a word are counted by its first place in each row."""
    words = F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda w: w != "")
    once = F.transform(F.array_distinct("words"), lambda w: F.struct(w.alias("word"), F.lit(0).alias("n"), F.lit(1).alias("docs")))
    each = F.transform("words", lambda w: F.struct(w.alias("word"), F.lit(1).alias("n"), F.lit(0).alias("docs")))
    return (
        table(spark, folder, "documents")
        .select(words.alias("words"))
        .select(F.explode(F.concat(each, once)).alias("w"))
        .groupBy("w.word")
        .agg(F.sum("w.n").alias("n"), F.sum("w.docs").alias("docs"))
    )


@query("""
SELECT o_orderkey, year(o_orderdate)::INTEGER AS y, month(o_orderdate)::INTEGER AS m,
  day(o_orderdate)::INTEGER AS d, quarter(o_orderdate)::INTEGER AS q,
  dayofweek(o_orderdate)::INTEGER AS weekday, dayofyear(o_orderdate)::INTEGER AS day_of_year,
  weekofyear(o_orderdate)::INTEGER AS week, date_trunc('month', o_orderdate)::TIMESTAMP AS month_start,
  date_trunc('week', o_orderdate)::TIMESTAMP AS week_start,
  last_day(o_orderdate)::VARCHAR AS month_end, o_orderdate + INTERVAL 90 DAY AS due,
  (o_orderdate::DATE + INTERVAL 2 MONTH)::DATE::VARCHAR AS two_months_on,
  date_diff('day', DATE '1995-01-01', o_orderdate::DATE)::INTEGER AS days_in,
  strftime(o_orderdate, '%Y/%m/%d') AS written, strptime(strftime(o_orderdate, '%d.%m.%Y'), '%d.%m.%Y')::DATE::VARCHAR AS parsed,
  make_date(year(o_orderdate), 1, 1)::VARCHAR AS new_year
FROM orders
""")
def functions_date(spark, folder):
    when = F.col("o_orderdate")
    day = when.cast("date")
    return table(spark, folder, "orders").select(
        "o_orderkey",
        F.year(when).alias("y"),
        F.month(when).alias("m"),
        F.day(when).alias("d"),
        F.quarter(when).alias("q"),
        (F.dayofweek(when) - 1).alias("weekday"),
        F.dayofyear(when).alias("day_of_year"),
        F.weekofyear(when).alias("week"),
        F.date_trunc("month", when).cast("timestamp_ntz").alias("month_start"),
        F.date_trunc("week", when).cast("timestamp_ntz").alias("week_start"),
        F.last_day(day).cast("string").alias("month_end"),
        (when + F.expr("INTERVAL 90 DAY")).alias("due"),
        F.add_months(day, 2).cast("string").alias("two_months_on"),
        F.date_diff(day, F.lit("1995-01-01").cast("date")).alias("days_in"),
        F.date_format(when, "yyyy/MM/dd").alias("written"),
        F.to_date(F.date_format(when, "dd.MM.yyyy"), "dd.MM.yyyy").cast("string").alias("parsed"),
        F.make_date(F.year(when), F.lit(1), F.lit(1)).cast("string").alias("new_year"),
    )


@query("""
SELECT event_id, hour(ts)::INTEGER AS h, minute(ts)::INTEGER AS mi, second(ts)::INTEGER AS s,
  date_trunc('hour', ts) AS hour_start, epoch_us(ts)::BIGINT AS micros,
  time_bucket(INTERVAL 15 MINUTE, ts) AS quarter_hour
FROM events
""")
def functions_time(spark, folder):
    ts = F.col("ts")
    quarter = F.window(ts, "15 minutes").getField("start")
    return table(spark, folder, "events").select(
        "event_id",
        F.hour(ts).alias("h"),
        F.minute(ts).alias("mi"),
        F.second(ts).alias("s"),
        F.date_trunc("hour", ts).cast("timestamp_ntz").alias("hour_start"),
        epoch_micros(ts).alias("micros"),
        quarter.alias("quarter_hour"),
    )


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, abs(l_tax - l_discount) AS gap, round(l_extendedprice, 0) AS rounded,
  floor(l_extendedprice / 100)::BIGINT AS hundreds, ceil(l_quantity / 7)::BIGINT AS sevens,
  (l_partkey % 17)::BIGINT AS remainder, (l_partkey // 17)::BIGINT AS quotient, sign(l_tax - l_discount)::INTEGER AS direction,
  greatest(l_tax, l_discount) AS higher, least(l_tax, l_discount) AS lower, sqrt(l_quantity) AS root,
  l_extendedprice / nullif(l_discount, 0) AS per_discount, (l_partkey & 255)::BIGINT AS low_bits, (l_partkey << 2)::BIGINT AS shifted,
  CASE WHEN l_quantity < 10 THEN 'small' WHEN l_quantity < 40 THEN 'medium' ELSE 'large' END AS size_class,
  coalesce(nullif(l_returnflag, 'N'), '-') AS flag, hex(l_partkey) AS hexed
FROM lineitem
""")
def functions_math(spark, folder):
    apart = F.col("l_tax") - F.col("l_discount")
    quantity = F.col("l_quantity")
    return table(spark, folder, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        F.abs(apart).alias("gap"),
        F.round("l_extendedprice", 0).alias("rounded"),
        F.floor(F.col("l_extendedprice") / 100).alias("hundreds"),
        F.ceil(quantity / 7).alias("sevens"),
        (F.col("l_partkey") % 17).alias("remainder"),
        F.expr("l_partkey div 17").alias("quotient"),
        F.signum(apart).cast("int").alias("direction"),
        F.greatest("l_tax", "l_discount").alias("higher"),
        F.least("l_tax", "l_discount").alias("lower"),
        F.sqrt(quantity).alias("root"),
        F.try_divide("l_extendedprice", "l_discount").alias("per_discount"),
        F.col("l_partkey").bitwiseAND(255).alias("low_bits"),
        F.shiftleft("l_partkey", 2).alias("shifted"),
        F.when(quantity < 10, "small").when(quantity < 40, "medium").otherwise("large").alias("size_class"),
        F.coalesce(F.nullif("l_returnflag", F.lit("N")), F.lit("-")).alias("flag"),
        F.hex("l_partkey").alias("hexed"),
    )


@query("""
SELECT vec_id, label, len(embedding)::INTEGER AS width, embedding[1]::DOUBLE AS first_value,
  list_max(embedding)::DOUBLE AS highest, list_min(embedding)::DOUBLE AS lowest,
  list_position(embedding, list_max(embedding))::BIGINT AS at_highest,
  len(list_filter(embedding, lambda x: x > 0))::INTEGER AS positives,
  list_reduce(list_transform(embedding, lambda x: round(x::DOUBLE * 1000000)::BIGINT), lambda a, b: a + b) AS micro_sum,
  array_to_string(list_transform(list_sort(embedding)[1:3], lambda x: (round(x::DOUBLE * 10000)::BIGINT)::VARCHAR), ',') AS three_lowest,
  list_bool_or(list_transform(embedding, lambda x: x > 0.3)) AS any_large
FROM embeddings
""")
def functions_array(spark, folder):
    e = F.col("embedding")
    micros = F.transform(e, lambda x: F.round(x.cast("double") * 1_000_000).cast("bigint"))
    lowest = F.slice(F.array_sort(e), 1, 3)
    return table(spark, folder, "embeddings").select(
        "vec_id",
        "label",
        F.size(e).alias("width"),
        e[0].cast("double").alias("first_value"),
        F.array_max(e).cast("double").alias("highest"),
        F.array_min(e).cast("double").alias("lowest"),
        F.array_position(e, F.array_max(e)).alias("at_highest"),
        F.size(F.filter(e, lambda x: x > 0)).alias("positives"),
        F.aggregate(micros, F.lit(0).cast("bigint"), lambda a, x: a + x).alias("micro_sum"),
        F.array_join(
            F.transform(lowest, lambda x: F.round(x.cast("double") * 10_000).cast("bigint").cast("string")),
            ",",
        ).alias("three_lowest"),
        F.exists(e, lambda x: x > 0.3).alias("any_large"),
    )


@query("""
SELECT label, place::INTEGER AS place, count(*) AS n, max(x)::DOUBLE AS highest, min(x)::DOUBLE AS lowest FROM (
  SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS place FROM embeddings)
GROUP BY label, place
""")
def functions_posexplode(spark, folder):
    return (
        table(spark, folder, "embeddings")
        .select("label", F.posexplode("embedding").alias("place", "x"))
        .groupBy("label", "place")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.max("x").cast("double").alias("highest"),
            F.min("x").cast("double").alias("lowest"),
        )
    )


@query("""
SELECT event_id, (props ->> 'k')::BIGINT AS k, json_type(props -> 'k') = 'UBIGINT' AS is_number,
  (props ->> 'absent') AS absent, json_keys(props)[1] AS first_key, props::VARCHAR AS raw
FROM events
""")
def functions_json(spark, folder):
    parsed = F.from_json("props", "k BIGINT")
    # The Variant type keeps a document's own types for later inspection.
    kind = F.schema_of_variant(F.variant_get(F.parse_json("props"), "$.k", "variant"))
    return table(spark, folder, "events").select(
        "event_id",
        parsed["k"].alias("k"),
        (kind == "BIGINT").alias("is_number"),
        F.get_json_object("props", "$.absent").alias("absent"),
        F.json_object_keys("props")[0].alias("first_key"),
        F.col("props").alias("raw"),
    )


@query("""
SELECT event_type, (props ->> 'k')::BIGINT AS k, count(*) AS n,
       sum(value::DECIMAL(12,2))::DOUBLE AS value
FROM events GROUP BY ALL
""")
def functions_json_group(spark, folder):
    return (
        table(spark, folder, "events")
        .groupBy("event_type", F.from_json("props", "k BIGINT")["k"].alias("k"))
        .agg(F.count(F.lit(1)).alias("n"), total(cents("value"), 2).alias("value"))
    )


@query("""
SELECT c_custkey, c_mktsegment AS segment, c_acctbal AS balance,
  '{"name":"' || c_name || '","nation":' || c_nationkey || '}' AS packed
FROM customer
""")
def functions_struct_map(spark, folder):
    """Structs and maps: built, read by name, written as JSON."""
    facts = F.create_map(F.lit("segment"), F.col("c_mktsegment"), F.lit("name"), F.col("c_name"))
    who = F.struct(F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"))
    return (
        table(spark, folder, "customer")
        .select("c_custkey", facts.alias("facts"), who.alias("who"), "c_acctbal")
        .select(
            "c_custkey",
            F.element_at("facts", F.lit("segment")).alias("segment"),
            F.col("c_acctbal").alias("balance"),
            F.to_json("who").alias("packed"),
        )
    )
