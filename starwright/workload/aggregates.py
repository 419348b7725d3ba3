"""Measures and aggregates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from starwright.functions import measures as M
from starwright.operators import rolling
from starwright.operators.quantiles import exact_percentiles
from starwright.operators.setops import aggregate_dimension
from starwright.workload.registry import Data, query
from starwright.workload.star import BARS_SQL, daily_bars, day_dimension


def r(df, **digits):
    """Round the named columns; -0.0 becomes 0.0."""
    return df.withColumns({c: F.round(F.col(c), n) + F.lit(0.0) for c, n in digits.items()})


@query("a1_group_aggregate", """
SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty,
       round(sum(l_extendedprice), 2) AS sum_price FROM lineitem GROUP BY 1, 2""")
def group_aggregate(data: Data):
    out = M.aggregate(data.lineitem, ["l_returnflag", "l_linestatus"], [
        M.Measure("sum_qty", "l_quantity"), M.Measure("sum_price", "l_extendedprice")])
    return r(out, sum_qty=2, sum_price=2)


@query("a2_basic_functions", """
SELECT o_orderpriority, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 6) AS mean,
       min(o_totalprice) AS low, max(o_totalprice) AS high, count(o_totalprice) AS n
FROM orders GROUP BY 1""")
def basic_functions(data: Data):
    out = M.aggregate(data.orders, ["o_orderpriority"], [
        [key, "o_totalprice", agg] for key, agg in
        (("total", "sum"), ("mean", "avg"), ("low", "min"), ("high", "max"), ("n", "count"))])
    return r(out, total=2, mean=6)


@query("a3_count_distinct", """
SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers
FROM lineitem GROUP BY 1""")
def count_distinct(data: Data):
    return M.aggregate(data.lineitem, ["l_returnflag"], [
        ["parts", "l_partkey", "count_distinct"], ["suppliers", "l_suppkey", "count_distinct"]])


@query("a4_aggregate_dimension", """
SELECT c_nationkey, 'nation ' || c_nationkey AS label, count(*) AS customers,
       round(sum(c_acctbal), 2) AS balance FROM customer GROUP BY 1""")
def aggregate_transform(data: Data):
    return aggregate_dimension(data.customer, ["c_nationkey"], {
        "label": "concat('nation ', c_nationkey)", "customers": "count(*)",
        "balance": "round(sum(c_acctbal), 2)"})


@query("a5_conditional", """
SELECT l_shipdate::DATE AS day, sum(l_quantity) FILTER (WHERE l_returnflag = 'R') AS returned
FROM lineitem GROUP BY 1""")
def conditional(data: Data):
    return M.aggregate(data.lineitem, [F.col("l_shipdate").cast("date").alias("day")], [
        ["returned", "sum(l_quantity) FILTER (WHERE l_returnflag = 'R')", "expression"]])


@query("a6_subtotals", """
SELECT CASE WHEN grouping(l_returnflag) = 1 THEN 'TOTAL' ELSE l_returnflag END AS l_returnflag,
       CASE WHEN grouping(l_linestatus) = 1 THEN 'TOTAL' ELSE l_linestatus END AS l_linestatus,
       round(sum(l_quantity), 2) AS qty, count(*) AS n
FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)""")
def subtotals(data: Data):
    from starwright.operators.pivot import PivotSpec, pivot

    out = pivot(data.lineitem, PivotSpec(
        rows={"l_returnflag": "l_returnflag", "l_linestatus": "l_linestatus"},
        measures=[["qty", "l_quantity", "sum"], ["n", "*", "count"]], row_totals=True))
    return r(out, qty=2)


@query("a7_case_sum", """
SELECT o_custkey, round(sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE 0 END), 2) AS paid,
       round(sum(CASE WHEN o_orderstatus = 'O' THEN o_totalprice ELSE 0 END), 2) AS due
FROM orders GROUP BY 1""")
def case_sum(data: Data):
    out = data.orders.groupBy("o_custkey").agg(
        M.sum_if("o_orderstatus = 'F'", "o_totalprice").alias("paid"),
        M.sum_if("o_orderstatus = 'O'", "o_totalprice").alias("due"))
    return r(out, paid=2, due=2)


@query("a8_ratio", """
SELECT l_suppkey, round(sum(l_quantity) / nullif(count(DISTINCT l_orderkey), 0), 6) AS per_order
FROM lineitem GROUP BY 1""")
def ratio(data: Data):
    out = data.lineitem.groupBy("l_suppkey").agg(M.ratio_of(
        F.sum("l_quantity"), F.count_distinct("l_orderkey")).alias("per_order"))
    return r(out, per_order=6)


@query("a9_rate", """
SELECT o_orderpriority, round(100.0 * sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END)
       / nullif(count(*), 0), 6) AS filled_rate FROM orders GROUP BY 1""")
def rate(data: Data):
    out = data.orders.groupBy("o_orderpriority").agg(
        M.rate_of("o_orderstatus = 'F'").alias("filled_rate"))
    return r(out, filled_rate=6)


@query("a10_measure_filters", """
SELECT event_type, count(*) FILTER (WHERE value > 20 AND user_id < 50) AS big,
       round(sum(value) FILTER (WHERE value > 20), 2) AS big_value FROM events GROUP BY 1""")
def measure_filters(data: Data):
    out = M.aggregate(data.events, ["event_type"], [
        M.Measure("big", "*", "count", where=["value > 20", "user_id < 50"]),
        M.Measure("big_value", "value", "sum", where="value > 20")])
    return r(out, big_value=2)


@query("a11_measure_of_measures", """
SELECT c_mktsegment, count(*) AS n, count(*) FILTER (WHERE c_acctbal < 0) AS debtors,
       round(count(*) FILTER (WHERE c_acctbal < 0) / count(*) * 100, 6) AS debtor_pct
FROM customer GROUP BY 1""")
def measure_of_measures(data: Data):
    out = M.aggregate(data.customer, ["c_mktsegment"], [
        ["n", "*", "count"], M.Measure("debtors", "*", "count", where="c_acctbal < 0"),
        ["share", {"fn": "divide", "a": "debtors", "b": "n"}],
        ["debtor_pct", {"fn": "multiply", "a": "share", "by": 100}]]).drop("share")
    return r(out, debtor_pct=6)


@query("a12_measure_over_join", """
SELECT p_brand, round(sum(CASE WHEN l_returnflag = 'R' THEN l_extendedprice ELSE 0 END), 2) AS returned
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1""")
def measure_over_join(data: Data):
    from starwright.operators.joins import edge, star_join

    df = star_join({"fact_lineitem": data.lineitem, "dim_part": data.part},
                   [edge("fact_lineitem", "dim_part", "l_partkey=p_partkey")])
    out = df.groupBy("p_brand").agg(
        M.sum_if("l_returnflag = 'R'", "l_extendedprice").alias("returned"))
    return r(out, returned=2)


@query("a13_median", """
SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.5), 5) AS median,
       round(quantile_cont(l_extendedprice, 0.9), 5) AS p90 FROM lineitem GROUP BY 1""")
def median(data: Data):
    return r(exact_percentiles(data.lineitem, ["l_returnflag"], "l_extendedprice", [0.5, 0.9],
                               ["median", "p90"]), median=5, p90=5)


@query("a14_first_value", """
SELECT o_custkey, arg_min(o_orderstatus, (o_orderdate, o_orderkey)) AS first_status
FROM orders GROUP BY 1""")
def first_value(data: Data):
    return data.orders.groupBy("o_custkey").agg(F.min_by(
        "o_orderstatus", F.struct("o_orderdate", "o_orderkey")).alias("first_status"))


@query("a15_text_set", """
SELECT p_type, array_to_string(list_sort(list(DISTINCT p_brand)), ', ') AS brands
FROM part GROUP BY 1""")
def text_set(data: Data):
    return data.part.groupBy("p_type").agg(M.text_set("p_brand").alias("brands"))


@query("a15_text_set_parts", """
WITH d AS (SELECT DISTINCT o_orderstatus, o_custkey::VARCHAR AS c FROM orders),
n AS (SELECT *, (row_number() OVER (PARTITION BY o_orderstatus ORDER BY c) - 1) // 100 AS part FROM d)
SELECT o_orderstatus, part, string_agg(c, ', ' ORDER BY c) AS buyers FROM n GROUP BY 1, 2""")
def text_set_parts(data: Data):
    buyers = data.orders.select("o_orderstatus", F.col("o_custkey").cast("string").alias("c"))
    return M.text_set_parts(buyers, ["o_orderstatus"], "c", "buyers", values=100)


@query("a16_distinct_conditional", """
SELECT o_orderpriority, count(DISTINCT CASE WHEN o_orderstatus = 'F' THEN o_custkey END) AS buyers
FROM orders GROUP BY 1""")
def distinct_conditional(data: Data):
    return M.aggregate(data.orders, ["o_orderpriority"], [
        M.Measure("buyers", "o_custkey", "count_distinct", where="o_orderstatus = 'F'")])


@query("a17_spread", f"""
WITH {BARS_SQL}
SELECT ticker, round(stddev_samp(close), 6) AS sd, round(stddev_samp(close) / avg(close), 8) AS cv,
       round(avg(high - low), 6) AS mean_range, round(avg(close * volume), 4) AS traded
FROM bars GROUP BY 1""")
def spread(data: Data):
    out = daily_bars(data).groupBy("ticker").agg(
        F.stddev_samp("close").alias("sd"), M.coefficient_of_variation("close").alias("cv"),
        F.expr("avg(high - low)").alias("mean_range"), F.expr("avg(close * volume)").alias("traded"))
    return r(out, sd=6, cv=8, mean_range=6, traded=4)


@query("a18_monthly", f"""
WITH {BARS_SQL}
SELECT ticker, strftime(trade_date, '%Y-%m') AS month, round(avg(close), 6) AS mean_close,
       CAST(sum(volume) AS BIGINT) AS volume FROM bars GROUP BY 1, 2""")
def monthly(data: Data):
    out = daily_bars(data).groupBy("ticker", F.date_format("trade_date", "yyyy-MM").alias("month")).agg(
        F.avg("close").alias("mean_close"), F.sum("volume").cast("long").alias("volume"))
    return r(out, mean_close=6)


@query("a19_weekly_bars", f"""
WITH {BARS_SQL}
SELECT ticker, CAST(date_trunc('week', trade_date) AS DATE) AS week,
       arg_min(open, trade_date) AS open, max(high) AS high, min(low) AS low,
       arg_max(close, trade_date) AS close, CAST(sum(volume) AS BIGINT) AS volume
FROM bars GROUP BY 1, 2""")
def weekly_bars(data: Data):
    return daily_bars(data).groupBy(
        "ticker", F.trunc("trade_date", "week").alias("week")).agg(
        F.min_by("open", "trade_date").alias("open"), F.max("high").alias("high"),
        F.min("low").alias("low"), F.max_by("close", "trade_date").alias("close"),
        F.sum("volume").cast("long").alias("volume"))


@query("a20_by_weekday", """
SELECT dayname(o_orderdate) AS day_of_week_name, count(*) AS orders,
       round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1""")
def by_weekday(data: Data):
    dated = data.orders.withColumn("date", F.col("o_orderdate").cast("date"))
    out = dated.join(day_dimension(data), "date").groupBy("day_of_week_name").agg(
        F.count(F.lit(1)).alias("orders"), F.sum("o_totalprice").alias("total"))
    return r(out, total=2)


@query("a21_measure_per_entity", """
SELECT o_custkey, round(avg(o_totalprice), 6) AS mean FROM orders GROUP BY 1
UNION ALL SELECT NULL, round(avg(o_totalprice), 6) FROM orders""")
def measure_per_entity(data: Data):
    m = [M.Measure("mean", "o_totalprice", "avg")]
    each = M.aggregate(data.orders, ["o_custkey"], m)
    overall = M.aggregate(data.orders, [], m)
    return r(each.unionByName(overall, allowMissingColumns=True), mean=6)


INDEX_SQL = f"""
WITH {BARS_SQL},
x AS (
  SELECT *, lag(close) OVER w AS prev, avg(volume) OVER f AS mv FROM bars
  WINDOW w AS (PARTITION BY ticker ORDER BY trade_date),
         f AS (PARTITION BY ticker ORDER BY trade_date ROWS 19 PRECEDING)),
y AS (
  SELECT *, stddev_samp((close - prev) / prev) OVER
    (PARTITION BY ticker ORDER BY trade_date ROWS 19 PRECEDING) AS sd FROM x),
z AS (
  SELECT trade_date, close, unnest(['equal', 'volume', 'market_cap', 'price', 'volume_deviation',
           'volatility']) AS weighting,
         unnest([1.0, volume, volume * close, close, abs((volume - mv) / nullif(mv, 0)),
           1 / nullif(sd, 0)]::DOUBLE[]) AS w FROM y)
SELECT trade_date, weighting, round(sum(w * close) / nullif(sum(w), 0), 7) AS index_value,
       count(*) AS members
FROM z WHERE w IS NOT NULL GROUP BY 1, 2"""


@query("a22_weighted_index", INDEX_SQL)
def weighted_index(data: Data):
    bars = daily_bars(data).withColumn("market_cap", F.col("volume") * F.col("close"))
    parts = [rolling.weighted_index(bars, "ticker", "trade_date", weighting=w)
             .withColumn("weighting", F.lit(w)) for w in rolling.WEIGHTINGS]
    return r(reduce(lambda a, b: a.unionByName(b), parts), index_value=7)


@query("a23_position_value", """
SELECT o_custkey, round(sum(l_quantity * p_retailprice), 2) AS value FROM lineitem
JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey GROUP BY 1""")
def position_value(data: Data):
    df = data.lineitem.join(data.part, F.col("l_partkey") == F.col("p_partkey")).join(
        data.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    out = df.groupBy("o_custkey").agg(
        F.sum(F.col("l_quantity") * F.col("p_retailprice")).alias("value"))
    return r(out, value=2)


@query("a24_allocation", """
SELECT p_brand, round(sum(l_extendedprice), 2) AS value,
       round(sum(l_extendedprice) / (SELECT sum(l_extendedprice) FROM lineitem) * 100, 6) AS pct
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1""")
def allocation(data: Data):
    groups = data.lineitem.join(data.part, F.col("l_partkey") == F.col("p_partkey")).groupBy(
        "p_brand").agg(F.sum("l_extendedprice").alias("value"))
    return r(M.with_share(groups, "value", "pct", 100.0), value=2, pct=6).orderBy(F.desc("pct"))
