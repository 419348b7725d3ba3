"""Sources: tables, JSON responses, CSV, seed rows, calendar.

Raw files are first derived from the tables by Spark, then read back through the source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starwright.operators import projection, setops
from starwright.session import scratch_path
from starwright.sources import csv_files, json_files, tables
from starwright.workload.registry import Data, query
from starwright.workload.star import BARS_SQL, daily_bars

IN_FOLDER = r"/entity=([^/]+)/"
TEXT = T.StringType()


def responses(df: DataFrame, entity: str, body, label: str) -> str:
    """One JSON file per entity, ``{"_meta": {…}, "response": …}``, below a fresh folder."""
    path = scratch_path(df.sparkSession, label)
    line = F.to_json(F.struct(F.struct(F.col(entity).alias("ticker")).alias("_meta"),
                              body.alias("response")))
    df.select(F.col(entity).alias("entity"), line.alias("value")).write.partitionBy(
        "entity").text(path)
    return path


def response_lines(df: DataFrame, entity: str, body, label: str) -> str:
    """The same as JSON lines, for feeds with very many small responses."""
    path = scratch_path(df.sparkSession, label)
    df.select(F.to_json(F.struct(
        F.struct(F.col(entity).cast("string").alias("ticker")).alias("_meta"),
        body.alias("response"))).alias("value")).write.text(path)
    return path


@query("s1_read_by_format", "SELECT p_partkey, p_brand, p_retailprice FROM part")
def read_by_format(data: Data):
    return tables.read_table(data.spark, data.path("part"), "parquet").select(
        "p_partkey", "p_brand", "p_retailprice")


@query("s2_scan", "SELECT s_suppkey, s_nationkey, s_acctbal FROM supplier")
def scan(data: Data):
    return tables.scan(data.spark, data.path("supplier")).select(
        "s_suppkey", "s_nationkey", "s_acctbal")


def _daily_response(data: Data):
    """Per ticker a map of date to the bar; its length is the number of days."""
    bar = F.struct(*[F.col(c).cast("string").alias(f"{i}. {c}")
                     for i, c in enumerate(("open", "high", "low", "close", "volume"), 1)])
    days = daily_bars(data).groupBy("ticker").agg(F.map_from_entries(F.collect_list(
        F.struct(F.col("trade_date").cast("string"), bar))).alias("days"))
    return responses(days, "ticker", F.struct(F.col("days").alias("Time Series (Daily)")), "daily")


NESTED_SQL = f"""
WITH {BARS_SQL}
SELECT ticker, CAST(trade_date AS VARCHAR) AS trade_date, open,
       close, CAST(volume AS BIGINT) AS volume
FROM bars"""


def _bar_columns(df: DataFrame) -> DataFrame:
    return df.select("ticker", "trade_date", F.col("`1. open`").try_cast("double").alias("open"),
                     F.col("`4. close`").try_cast("double").alias("close"),
                     F.col("`5. volume`").try_cast("double").cast("long").alias("volume"))


@query("s3_nested_map_json", NESTED_SQL)
def nested_map_json(data: Data):
    names = ("open", "high", "low", "close", "volume")
    values = T.StructType([T.StructField(f"{i}. {n}", TEXT) for i, n in enumerate(names, 1)])
    return _bar_columns(json_files.read_nested_map(
        data.spark, _daily_response(data), "Time Series (Daily)", values,
        entity_pattern=IN_FOLDER))


@query("s3_nested_map_json_inferred", NESTED_SQL)
def nested_map_json_inferred(data: Data):
    return _bar_columns(json_files.read_nested_map(
        data.spark, _daily_response(data), "Time Series (Daily)", None, entity_pattern=IN_FOLDER))


@query("s4_object_json", """
SELECT CAST(c_custkey AS VARCHAR) AS ticker, c_name AS "Name", c_mktsegment AS "Sector",
       CAST(c_nationkey AS VARCHAR) AS "Country" FROM customer""")
def object_json(data: Data):
    path = response_lines(data.customer, "c_custkey", F.struct(
        F.col("c_name").alias("Name"), F.col("c_mktsegment").alias("Sector"),
        F.col("c_nationkey").cast("string").alias("Country")), "objects")
    schema = T.StructType([T.StructField(n, TEXT) for n in ("Name", "Sector", "Country")])
    return json_files.read_objects(data.spark, path, schema, lines=True)


@query("s5_array_json", """
SELECT CAST(o_custkey AS VARCHAR) AS ticker, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day,
       CAST(count(*) AS VARCHAR) AS orders
FROM orders GROUP BY 1, 2""")
def array_json(data: Data):
    daily = data.orders.groupBy(
        "o_custkey", F.col("o_orderdate").cast("date").alias("day")
    ).agg(F.count(F.lit(1)).alias("orders"))
    # one response per customer and year, so a list has at most 366 entries
    yearly = daily.groupBy("o_custkey", F.year("day").alias("y")).agg(F.collect_list(F.struct(
        F.col("day").cast("string").alias("day"), F.col("orders").cast("string").alias("orders"))
    ).alias("items"))
    path = response_lines(yearly, "o_custkey", F.col("items"), "arrays")
    schema = T.StructType([T.StructField("day", TEXT), T.StructField("orders", TEXT)])
    return json_files.read_arrays(data.spark, path, schema, lines=True)


@query("s6_report_arrays_json", """
SELECT CAST(o_custkey AS VARCHAR) AS ticker, 'annual' AS report_type,
       strftime(o_orderdate, '%Y') AS period, CAST(count(*) AS VARCHAR) AS orders
FROM orders GROUP BY ALL
UNION ALL
SELECT CAST(o_custkey AS VARCHAR), 'quarterly',
       year(o_orderdate) || '-Q' || quarter(o_orderdate), CAST(count(*) AS VARCHAR)
FROM orders GROUP BY ALL""")
def report_arrays_json(data: Data):
    d = F.col("o_orderdate")
    quarter = F.concat(F.year(d).cast("string"), F.lit("-Q"), F.quarter(d).cast("string"))
    parts = []
    for kind, period in (("annualReports", F.year(d).cast("string")), ("quarterlyReports", quarter)):
        counted = data.orders.groupBy("o_custkey", period.alias("period")).agg(
            F.count(F.lit(1)).cast("string").alias("orders"))
        parts.append(counted.groupBy("o_custkey").agg(
            F.collect_list(F.struct("period", "orders")).alias(kind)))
    both = parts[0].join(parts[1], "o_custkey")
    path = response_lines(both, "o_custkey", F.struct("annualReports", "quarterlyReports"), "reports")
    schema = T.StructType([T.StructField("period", TEXT), T.StructField("orders", TEXT)])
    return json_files.read_reports(data.spark, path, schema, lines=True)


@query("s7_csv", """
SELECT CAST(o_orderkey AS BIGINT) AS order_id, CAST(o_orderdate AS DATE) AS order_date,
       o_totalprice AS total, o_orderpriority || chr(10) || o_orderstatus AS note,
       CAST(NULL AS VARCHAR) AS absent, year(o_orderdate)::INTEGER AS year
FROM orders""")
def csv(data: Data):
    path = scratch_path(data.spark, "csv")
    data.orders.select(
        F.col("o_orderkey").alias("Order ID"),
        F.date_format("o_orderdate", "M/d/yyyy").alias("Order Date"),
        F.col("o_totalprice").alias("Total ($)"),
        F.concat("o_orderpriority", F.lit("\n"), "o_orderstatus").alias("Note"),
    ).write.csv(path, header=True, quoteAll=True, escape='"')
    return csv_files.read_csv(data.spark, path, [
        {"name": "order_id", "type": "long"}, {"name": "order_date", "type": "date"},
        {"name": "total", "type": "double"}, {"name": "note", "type": "string"},
        {"name": "absent", "type": "string"},
    ], year_from="order_date")


@query("s7_two_headers", """
SELECT o_orderkey AS order_id, o_totalprice AS total,
       CASE WHEN o_orderstatus = 'O' THEN o_orderpriority END AS priority FROM orders""")
def csv_two_headers(data: Data):
    """One folder of files whose columns stand in another order, or are missing."""
    path = scratch_path(data.spark, "csv")
    names = {"Order ID": "o_orderkey", "Total": "o_totalprice", "Priority": "o_orderpriority"}
    for part, (where, columns) in enumerate((("o_orderstatus = 'O'", list(names)),
                                             ("o_orderstatus <> 'O'", ["Total", "Order ID"]))):
        data.orders.filter(where).select(*[F.col(names[c]).alias(c) for c in columns]).write.csv(
            f"{path}/{part}", header=True)
    return csv_files.read_csv(data.spark, [f"{path}/0", f"{path}/1"], [
        {"name": "order_id", "type": "long"}, {"name": "total", "type": "double"}, {"name": "priority", "type": "string"}])


@query("s8_read_many", """
SELECT year(o_orderdate)::INTEGER AS order_year, count(*) AS orders,
       round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1""")
def read_many(data: Data):
    path = scratch_path(data.spark, "by-year")
    dated = data.orders.withColumn("y", F.year("o_orderdate"))
    dated.write.partitionBy("y").parquet(path)
    first, last = dated.agg(F.min("y"), F.max("y")).first()
    years = tables.read_many(
        [f"{path}/y={y}" for y in range(first, last + 1)
         if tables.path_exists(data.spark, f"{path}/y={y}")],
        lambda p: tables.read_table(data.spark, p))
    return years.groupBy(F.year("o_orderdate").alias("order_year")).agg(
        F.count(F.lit(1)).alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("s9_seed", """
WITH seed(segment, rank) AS (VALUES ('AUTOMOBILE', 1), ('BUILDING', 2), ('FURNITURE', 3),
                                    ('MACHINERY', 4), ('HOUSEHOLD', 5))
SELECT s.segment, s.rank, s.rank * 10 AS score, count(c_custkey) AS customers
FROM seed s LEFT JOIN customer ON c_mktsegment = s.segment GROUP BY ALL""")
def seed(data: Data):
    rows = [{"segment": s, "rank": i} for i, s in enumerate(
        ("AUTOMOBILE", "BUILDING", "FURNITURE", "MACHINERY", "HOUSEHOLD"), 1)]
    segments = tables.seed(data.spark, rows, [
        ["segment", "string", False, "market segment"], ["rank", "int", True, "order"],
        ["score", "int", True, "ten times the rank", {"derived": "rank * 10"}],
    ])
    return segments.join(data.customer, F.col("segment") == F.col("c_mktsegment"), "left").groupBy(
        "segment", "rank", "score").agg(F.count("c_custkey").alias("customers"))


@query("s10_empty_typed", "SELECT c_custkey, c_acctbal, CAST(NULL AS DATE) AS since FROM customer")
def empty_typed(data: Data):
    none = tables.empty(data.spark, [
        ["c_custkey", "long"], ["c_acctbal", "double"], ["since", "date"]])
    return setops.union([none, data.customer.select("c_custkey", "c_acctbal")])


@query("s11_calendar", """
WITH days AS (
  SELECT CAST(d AS DATE) AS date FROM (
    SELECT unnest(generate_series(min(CAST(o_orderdate AS DATE)), max(CAST(o_orderdate AS DATE)),
                                  INTERVAL 1 DAY)) AS d FROM orders)),
parts AS (
  SELECT *, month(date)::INTEGER AS m, year(date)::INTEGER AS y, day(date)::INTEGER AS dm,
         dayofweek(date)::INTEGER + 1 AS dw, last_day(date) AS me,
         ((month(date) - 7 + 12) % 12 + 1)::INTEGER AS fm FROM days)
SELECT CAST(strftime(date, '%Y%m%d') AS INTEGER) AS date_id, date, y AS year,
       quarter(date)::INTEGER AS quarter, m AS month, strftime(date, '%B') AS month_name,
       strftime(date, '%b') AS month_abbr, weekofyear(date)::INTEGER AS week_of_year,
       dm AS day_of_month, dw AS day_of_week, strftime(date, '%A') AS day_of_week_name,
       strftime(date, '%a') AS day_of_week_abbr, dayofyear(date)::INTEGER AS day_of_year,
       dw IN (1, 7) AS is_weekend, dw NOT IN (1, 7) AS is_weekday, dm = 1 AS is_month_start,
       date = me AS is_month_end, dm = 1 AND m IN (1, 4, 7, 10) AS is_quarter_start,
       date = me AND m IN (3, 6, 9, 12) AS is_quarter_end, dm = 1 AND m = 1 AS is_year_start,
       dm = 31 AND m = 12 AS is_year_end, CASE WHEN m >= 7 THEN y ELSE y - 1 END AS fiscal_year,
       ((fm - 1) // 3 + 1)::INTEGER AS fiscal_quarter, fm AS fiscal_month,
       day(me)::INTEGER AS days_in_month, strftime(date, '%Y-%m') AS year_month,
       y || '-Q' || quarter(date) AS year_quarter, strftime(date, '%Y-%m-%d') AS date_str
FROM parts""")
def calendar(data: Data):
    day = F.col("o_orderdate").cast("date")
    low, high = data.orders.agg(F.min(day), F.max(day)).first()
    return tables.calendar(data.spark, str(low), str(high), fiscal_start=7)


@query("s12_normalize", """
SELECT event_id AS id, CAST(ts AS DATE) AS day,
       CASE WHEN event_type = 'error' THEN NULL ELSE value END AS amount,
       CASE WHEN event_type = 'error' THEN NULL ELSE value * 2 END AS doubled,
       CAST(NULL AS VARCHAR) AS note, 'feed' AS origin
FROM events""")
def normalize(data: Data):
    raw = data.events.select(
        F.col("event_id").cast("string").alias("Event Id"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("at"),
        F.when(F.col("event_type") == "error", " N/A ").otherwise(F.col("value").cast("string"))
        .alias("val"))
    return projection.normalize(raw, [
        {"name": "id", "type": "long", "source": "Event Id"},
        {"name": "day", "type": "date", "source": "at"},
        {"name": "amount", "type": "double", "source": "val"},
        {"name": "doubled", "type": "double", "expr": "amount * 2"},
        {"name": "note", "type": "string"},
    ], {"origin": "feed"})
