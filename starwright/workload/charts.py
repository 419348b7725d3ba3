"""Requests over the star: charts, tables, KPI rows, value lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from starwright.plans import requests as R
from starwright.plans import views
from starwright.workload.registry import Data, query
from starwright.workload.star import BARS_SQL, daily_bars, star

CUSTOMER_PATH = ["fact_lineitem", "fact_orders", "dim_customer", "dim_nation", "dim_region"]

SALES_SQL = """
fact_lineitem_x AS (
  SELECT l.*, o.*, c.*, n.*, r.*
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey)
"""


@query("q1_chart_region_month", f"""
WITH {SALES_SQL}
SELECT strftime(o_orderdate, '%Y-%m') AS year_month, r_name,
       round(sum(l_extendedprice), 2) AS l_extendedprice
FROM fact_lineitem_x
WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1997-01-01' AND DATE '1998-12-31'
GROUP BY 1, 2""")
def chart_region_month(data: Data):
    out = R.chart(
        star(data), "temporal.year_month", "sales.l_extendedprice", "geo.r_name", "sum",
        filters=[{"field": "temporal.date", "op": "between",
                  "value": {"from": "1997-01-01", "to": "1998-12-31"}}],
        path=CUSTOMER_PATH)
    return out.withColumn("l_extendedprice", F.round("l_extendedprice", 2))


@query("q1_chart_multi_series", """
SELECT o_orderdate::DATE AS date, round(avg(o_totalprice), 5) AS o_totalprice,
       round(avg(o_custkey), 5) AS o_custkey FROM orders GROUP BY 1""")
def chart_multi_series(data: Data):
    out = R.chart(star(data), "temporal.date", ["sales.o_totalprice", "sales.o_custkey"])
    return out.withColumns({c: F.round(c, 5) for c in ("o_totalprice", "o_custkey")})


@query("q2_series_lists", """
SELECT o_orderpriority AS series, 0::BIGINT AS part, count(*) AS points, min(m) AS first_x, max(m) AS last_x,
       round(arg_min(y, m), 4) AS first_y, round(arg_max(y, m), 4) AS last_y, round(sum(y), 3) AS sum_y
FROM (SELECT o_orderpriority, strftime(o_orderdate, '%Y-%m') AS m, avg(o_totalprice) AS y FROM orders GROUP BY 1, 2)
GROUP BY 1""")
def series_lists(data: Data):
    points = R.chart(star(data), "temporal.year_month", "sales.o_totalprice", "sales.o_orderpriority")
    return _ends(R.series(points, "year_month", "o_totalprice", "o_orderpriority"))


def _ends(lists):
    first, last = F.col("points")[0], F.element_at("points", -1)
    total = F.aggregate("points", F.lit(0.0), lambda a, p: a + p["y"])
    return lists.select(
        "series", "part", F.size("points").cast("long").alias("points"),
        first["x"].alias("first_x"), last["x"].alias("last_x"), F.round(first["y"], 4).alias("first_y"),
        F.round(last["y"], 4).alias("last_y"), F.round(total, 3).alias("sum_y"))


@query("q2_series_whole", """
WITH d AS (SELECT o_orderdate::DATE AS x, avg(o_totalprice) AS y FROM orders GROUP BY 1),
n AS (SELECT *, (row_number() OVER (ORDER BY x) - 1) // 500 AS part FROM d)
SELECT 'all' AS series, part, count(*) AS points, min(x) AS first_x, max(x) AS last_x,
       round(arg_min(y, x), 4) AS first_y, round(arg_max(y, x), 4) AS last_y, round(sum(y), 3) AS sum_y
FROM n GROUP BY part""")
def series_whole(data: Data):
    """One series without a group, continued every 500 points."""
    points = R.chart(star(data), "temporal.date", "sales.o_totalprice")
    return _ends(R.series(points, "date", "o_totalprice", max_points=500))


@query("q3_box", "SELECT c_mktsegment, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey")
def box(data: Data):
    return R.box(star(data), "parties.c_mktsegment", "sales.o_totalprice")


@query("q3_box_summary", """
SELECT c_mktsegment, min(o_totalprice) AS min, round(quantile_cont(o_totalprice, 0.25), 4) AS q1,
       round(quantile_cont(o_totalprice, 0.5), 4) AS median, round(quantile_cont(o_totalprice, 0.75), 4) AS q3,
       max(o_totalprice) AS max, count(*) AS n
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1""")
def box_summary(data: Data):
    rows = R.box(star(data), "parties.c_mktsegment", "sales.o_totalprice")
    out = R.box_summary(rows, ["c_mktsegment"], "o_totalprice")
    return out.withColumns({c: F.round(c, 4) for c in ("q1", "median", "q3")})


@query("q4_ohlc", f"""
WITH {BARS_SQL} SELECT ticker || ' ' || trade_date::DATE::VARCHAR AS category, open, high, low, close FROM bars""")
def ohlc(data: Data):
    bars = daily_bars(data).withColumn("bar", F.concat_ws(" ", "ticker", F.col("trade_date").cast("date")))
    return R.ohlc(R.single_table(bars, "prices", "bars"), "prices.bar", "prices.open", "prices.high",
                  "prices.low", "prices.close")


@query("q5_flat_table_grouped", """
SELECT c_mktsegment AS segment, n_name AS nation, round(sum(o_totalprice), 2) AS total,
       count(DISTINCT o_custkey) AS customers
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2""")
def flat_table_grouped(data: Data):
    out = R.flat_table(star(data), [
        ["segment", "parties.c_mktsegment"], ["nation", "geo.n_name"],
        ["total", "sales.o_totalprice", "sum", "$", "Total"],
        ["customers", "sales.o_custkey", "count_distinct"]], sort={"by": "total", "order": "desc"})
    return out.withColumn("total", F.round("total", 2))


@query("q5_flat_table_rows", """
SELECT o_orderkey AS id, c_name AS customer FROM orders JOIN customer ON o_custkey = c_custkey
WHERE o_orderpriority = '1-URGENT' AND c_mktsegment = 'BUILDING'""")
def flat_table_rows(data: Data):
    return R.flat_table(star(data), [["id", "sales.o_orderkey"], ["customer", "parties.c_name"]], filters=[
        {"field": "sales.o_orderpriority", "value": "1-URGENT"},
        {"field": "parties.c_mktsegment", "op": "in", "value": ["BUILDING"]}])


@query("q6_kpi", """
SELECT round(sum(o_totalprice), 2) AS total, count(DISTINCT o_custkey) AS customers,
       round(sum(o_totalprice) / count(DISTINCT o_custkey), 6) AS per_customer FROM orders
WHERE year(o_orderdate) = 1998""")
def kpi(data: Data):
    out = R.kpi(star(data), [
        ["total", "sales.o_totalprice", "sum"], ["customers", "sales.o_custkey", "count_distinct"],
        ["per_customer", {"fn": "divide", "a": "total", "b": "customers"}]],
        [{"field": "temporal.year", "op": "eq", "value": 1998}])
    return out.withColumns({"total": F.round("total", 2), "per_customer": F.round("per_customer", 6)})


@query("q7_pivot_request", """
SELECT n_name, count(*) FILTER (WHERE o_orderstatus = 'F') AS "F||n", count(*) FILTER (WHERE o_orderstatus = 'O') AS "O||n",
       count(*) FILTER (WHERE o_orderstatus = 'P') AS "P||n"
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
WHERE c_mktsegment IN ('BUILDING', 'FURNITURE') GROUP BY 1""")
def pivot_by_request(data: Data):
    return R.pivot_request(
        star(data), ["geo.n_name"], [["n", "sales.o_orderkey", "count"]], ["sales.o_orderstatus"],
        [{"field": "parties.c_mktsegment", "value": ["BUILDING", "FURNITURE"]}], layout="by_column",
        sort={"by": "n", "where": "O", "order": "desc"})


@query("q8_field_resolution", """
SELECT quarter(o_orderdate)::INTEGER AS quarter, year(o_orderdate)::INTEGER AS year, count(*) AS n
FROM orders GROUP BY 1, 2""")
def field_resolution(data: Data):
    return R.flat_table(star(data), [
        ["quarter", "temporal.quarter"], ["year", "temporal.dim_calendar.year"],
        ["n", "sales.fact_orders.o_orderkey", "count"]])


@query("q9_single_table", """
SELECT event_type, count(*) AS n, round(sum(value), 2) AS total FROM events
WHERE user_id >= 10 GROUP BY 1""")
def single_table(data: Data):
    catalog = R.single_table(data.events, "feed.events", "raw_events")
    out = R.flat_table(catalog, [
        ["event_type", "feed.events.event_type"], ["n", "feed.events.event_id", "count"],
        ["total", "feed.events.value", "sum"]], [{"field": "feed.events.user_id", "op": "gte", "value": 10}])
    return out.withColumn("total", F.round("total", 2))


@query("q10_display_formats", """
SELECT n_name, '$' || format('{:,.0f}', total) AS dollars, '$' || format('{:,.2f}', total) AS cents,
       '$' || format('{:,.1f}', total / 1000) || 'K' AS thousands, format('{:,.0f}', n) AS n,
       format('{:.2f}', share * 100) || '%' AS share
FROM (SELECT n_name, round(sum(c_acctbal), 2) + 0.001 AS total, count(*)::DOUBLE AS n,
             round(avg((c_acctbal > 0)::INT), 6) + 0.000001 AS share
      FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1)""")
def display_formats(data: Data):
    df = data.customer.join(data.nation, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(
        (F.round(F.sum("c_acctbal"), 2) + 0.001).alias("total"), F.count(F.lit(1)).cast("double").alias("n"),
        (F.round(F.avg((F.col("c_acctbal") > 0).cast("int")), 6) + 0.000001).alias("share"))
    cols = df.select("n_name", F.col("total").alias("dollars"), F.col("total").alias("cents"),
                     F.col("total").alias("thousands"), "n", "share")
    return R.formatted(cols, {"dollars": "$", "cents": "$2", "thousands": "$K", "n": "number", "share": "%"})


@query("q11_heatmap", """
SELECT day_of_week_name, o_orderpriority, round(avg(o_totalprice), 5) AS o_totalprice
FROM (SELECT dayname(o_orderdate) AS day_of_week_name, * FROM orders) GROUP BY 1, 2""")
def heatmap(data: Data):
    out = R.heatmap(star(data), "temporal.day_of_week_name", "sales.o_orderpriority", "sales.o_totalprice")
    return out.withColumn("o_totalprice", F.round("o_totalprice", 5))


@query("q11_heatmap_wide", """
SELECT o_orderpriority, max(s) FILTER (WHERE o_orderstatus = 'F') AS "F", max(s) FILTER (WHERE o_orderstatus = 'O') AS "O",
       max(s) FILTER (WHERE o_orderstatus = 'P') AS "P"
FROM (SELECT o_orderpriority, o_orderstatus, max(o_totalprice) AS s FROM orders GROUP BY 1, 2) GROUP BY 1""")
def heatmap_wide(data: Data):
    return R.heatmap(star(data), "sales.o_orderpriority", "sales.o_orderstatus", "sales.o_totalprice", "max", wide=True)


@query("q12_derived_view", """
SELECT o_orderkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 1.5 ELSE 1.0 END::DOUBLE AS factor,
       o_totalprice * (CASE WHEN c_mktsegment = 'BUILDING' THEN 1.5 ELSE 1.0 END)::DOUBLE AS equalized,
       o_totalprice * (CASE WHEN c_mktsegment = 'BUILDING' THEN 1.5 ELSE 1.0 END)::DOUBLE * 0.05::DOUBLE AS tax
FROM orders JOIN customer ON o_custkey = c_custkey""")
def derived_view(data: Data):
    """A view on a view: looked-up factor or its default, then an assumed rate."""
    factors = data.customer.filter("c_mktsegment = 'BUILDING'").select(
        "c_custkey", F.lit(1.5).alias("factor"))
    equalized = views.derived_view(
        data.orders, {"equalized": "o_totalprice * factor"}, factors, ["o_custkey=c_custkey"], {"factor": 1.0})
    return views.derived_view(equalized, {"tax": "equalized * rate"}, assumptions={"rate": 0.05},
                              columns=["o_orderkey", "factor", "equalized", "tax"])


@query("q13_rollup_view", """
SELECT o_orderstatus, year(o_orderdate)::INTEGER AS y, count(DISTINCT o_custkey) AS customers,
       round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1, 2""")
def rollup_view(data: Data):
    base = data.orders.withColumn("y", F.year("o_orderdate"))
    return views.rollup_view(base, ["o_orderstatus", "y"], {
        "customers": "count(distinct o_custkey)", "total": "round(sum(o_totalprice), 2)"})


@query("q14_wide_subsets", """
SELECT 'buyer' AS kind, c_custkey AS id, c_mktsegment AS segment, CAST(NULL AS DOUBLE) AS credit FROM customer
UNION ALL SELECT 'seller', s_suppkey, NULL, s_acctbal FROM supplier""")
def wide_subsets(data: Data):
    return views.wide_subsets({
        "buyer": data.customer.select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment")),
        "seller": data.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("credit"))}, "kind")


@query("q14_subset", """
SELECT s_suppkey AS id, s_acctbal AS credit FROM supplier""")
def subset(data: Data):
    return views.subset(wide_subsets(data), "kind", "seller", ["id"], ["credit"])


@query("q14_subset_violations", """
SELECT 'buyer' AS kind, count(*) FILTER (c_nationkey < 5) AS violations FROM customer
UNION ALL SELECT 'seller', count(*) FILTER (s_acctbal < 0) FROM supplier""")
def subset_violations(data: Data):
    """Buyers of some nations with a credit, and sellers in debt with a segment, break the rule."""
    wide = views.wide_subsets({
        "buyer": data.customer.select(F.col("c_mktsegment").alias("segment"),
                                      F.when(F.col("c_nationkey") < 5, F.col("c_acctbal")).alias("credit")),
        "seller": data.supplier.select(F.when(F.col("s_acctbal") < 0, F.lit("DEBT")).alias("segment"),
                                       F.col("s_acctbal").alias("credit"))}, "kind")
    return views.subset_violations(wide, "kind", {"buyer": ["segment"], "seller": ["credit"]})
