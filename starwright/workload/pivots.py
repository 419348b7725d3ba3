"""Pivots: totals, layouts, bins, sorting, windows; unpivots."""

from __future__ import annotations

from pyspark.sql import functions as F

from starwright.operators import setops
from starwright.operators.pivot import PivotSpec, combo_key, pivot, pivot_long, pivot_pages, pivot_plain
from starwright.operators.pivot import column_values as pivot_columns
from starwright.plans import requests as R
from starwright.workload.aggregates import r
from starwright.workload.charts import CUSTOMER_PATH, SALES_SQL
from starwright.workload.registry import Data, query
from starwright.workload.star import star


@query("v1_one_dimensional", """
SELECT c_mktsegment, round(sum(o_totalprice), 2) AS total, count(o_orderkey) AS n
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1""")
def one_dimensional(data: Data):
    out = R.pivot_request(star(data), ["parties.c_mktsegment"], [
        ["total", "sales.o_totalprice", "sum"], ["n", "sales.o_orderkey", "count"]])
    return r(out, total=2)


REGION_YEAR = """
SELECT CASE WHEN grouping(r_name) = 1 THEN 'TOTAL' ELSE r_name END AS r_name,
       CASE WHEN grouping(n_name) = 1 THEN 'TOTAL' ELSE n_name END AS n_name,
""" + ",\n".join(
    f"       round(sum(l_extendedprice) FILTER (WHERE year(o_orderdate) = {y}), 2) AS \"sales||{y}\""
    for y in range(1995, 2002)) + "\nFROM fact_lineitem_x GROUP BY ROLLUP (r_name, n_name)"


@query("v2_wide_with_totals", f"WITH {SALES_SQL} {REGION_YEAR}")
def wide_with_totals(data: Data):
    out = R.pivot_request(
        star(data), ["geo.r_name", "geo.n_name"], [["sales", "sales.l_extendedprice", "sum"]],
        cols=["temporal.year"], path=CUSTOMER_PATH, row_totals=True)
    return r(out, **{c: 2 for c in out.columns if "||" in c})


@query("v3_column_values", """
SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem
WHERE l_returnflag IS NOT NULL AND l_linestatus IS NOT NULL""")
def column_values(data: Data):
    """The combinations a pivot gets as columns."""
    found = pivot_columns(data.lineitem, ["l_returnflag", "l_linestatus"])
    return data.lineitem.select("l_returnflag", "l_linestatus").distinct().filter(
        F.concat_ws("||", "l_returnflag", "l_linestatus").isin([combo_key(c) for c in found]))


QUANTITIES = [(q, flag, status) for q in range(1, 51) for flag in "ANR" for status in "FO"]


@query("v3_over_200_columns", "SELECT l_shipmode_day AS weekday, " + ", ".join(
    f"count(*) FILTER (WHERE l_quantity = {q} AND l_returnflag = '{f}' AND l_linestatus = '{s}') AS \"n||{q}||{f} | {s}\""
    for q, f, s in QUANTITIES) + " FROM (SELECT *, isodow(l_shipdate)::INTEGER AS l_shipmode_day FROM lineitem) GROUP BY 1")
def over_200_columns(data: Data):
    """300 combinations of quantity, flag and status, read as two pages of one set of groups and joined."""
    spec = PivotSpec(rows={"weekday": "weekday(l_shipdate) + 1"}, cols={
        "q": "cast(l_quantity as int)", "flag": "l_returnflag", "status": "l_linestatus"}, measures=[["n", "*", "count"]])
    pages = list(pivot_pages(data.lineitem, spec, 200))
    out = pages[0]
    for page in pages[1:]:
        out = out.join(page, "weekday")
    return out


@query("v3_long_any_number", """
SELECT o_orderpriority AS priority, o_orderkey::VARCHAR || '||' || o_orderstatus AS "column", count(*) AS n,
       round(sum(o_totalprice), 2) AS total, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY 1, 2""")
def long_any_number(data: Data):
    """As many column combinations as orders, as rows."""
    out = pivot_long(data.orders, PivotSpec(
        rows={"priority": "o_orderpriority"}, cols={"o": "o_orderkey", "s": "o_orderstatus"}, measures=[
            ["n", "*", "count"], ["total", "o_totalprice", "sum"], ["customers", "o_custkey", "count_distinct"]]))
    return r(out, total=2)


@query("v4_multi_column_keys", """
SELECT o_orderpriority, count(*) FILTER (WHERE l_returnflag = 'A' AND l_linestatus = 'F') AS "n||A||F",
       count(*) FILTER (WHERE l_returnflag = 'A' AND l_linestatus = 'O') AS "n||A||O",
       count(*) FILTER (WHERE l_returnflag = 'N' AND l_linestatus = 'F') AS "n||N||F",
       count(*) FILTER (WHERE l_returnflag = 'N' AND l_linestatus = 'O') AS "n||N||O",
       count(*) FILTER (WHERE l_returnflag = 'R' AND l_linestatus = 'F') AS "n||R||F",
       count(*) FILTER (WHERE l_returnflag = 'R' AND l_linestatus = 'O') AS "n||R||O"
FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1""")
def multi_column_keys(data: Data):
    return R.pivot_request(
        star(data), ["sales.o_orderpriority"], [["n", "sales.l_orderkey", "count"]],
        cols=["sales.l_returnflag", "sales.l_linestatus"])


LAYOUT_SQL = """
SELECT l_linestatus, {cols} FROM lineitem GROUP BY 1"""


def _layout_columns(name) -> str:
    return ", ".join(
        f"CAST({agg} FILTER (WHERE l_returnflag = '{v}') AS BIGINT) AS \"{name(v, k)}\""
        for v in "ANR" for k, agg in (("qty", "sum(l_quantity)"), ("n", "count(*)")))


def _layout(data: Data, layout: str):
    out = pivot(data.lineitem, PivotSpec(
        rows={"l_linestatus": "l_linestatus"}, cols={"flag": "l_returnflag"},
        measures=[["qty", "l_quantity", "sum"], ["n", "*", "count"]], layout=layout))
    return out.withColumns({c: F.col(f"`{c}`").cast("long") for c in out.columns if "qty" in c})


@query("v5_layout_by_measure", LAYOUT_SQL.format(cols=_layout_columns(lambda v, k: f"{k}||{v}")))
def layout_by_measure(data: Data):
    return _layout(data, "by_measure")


@query("v5_layout_by_column", LAYOUT_SQL.format(cols=_layout_columns(lambda v, k: f"{v}||{k}")))
def layout_by_column(data: Data):
    return _layout(data, "by_column")


@query("v5_layout_by_dimension", LAYOUT_SQL.format(cols=_layout_columns(lambda v, k: f"{k}||{v}")))
def layout_by_dimension(data: Data):
    return _layout(data, "by_dimension")


@query("v6_sort_by_field", """
SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1 ORDER BY min(o_totalprice)""")
def sort_by_field(data: Data):
    return pivot(data.orders, PivotSpec(
        rows={"o_orderpriority": "o_orderpriority"}, measures=[["n", "*", "count"]],
        sort={"field": "o_totalprice", "dir": "asc"}))


@query("v7_sort_by_column_value", """
SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS "n||F",
       count(*) FILTER (WHERE o_orderstatus = 'O') AS "n||O",
       count(*) FILTER (WHERE o_orderstatus = 'P') AS "n||P" FROM orders GROUP BY 1""")
def sort_by_column_value(data: Data):
    return pivot(data.orders, PivotSpec(
        rows={"o_orderpriority": "o_orderpriority"}, cols={"s": "o_orderstatus"},
        measures=[["n", "*", "count"]], sort={"by": "n", "where": "F", "order": "desc"}))


@query("v8_computed_measures", """
WITH b AS (
  SELECT l_returnflag, l_linestatus, sum(l_extendedprice) AS a, sum(l_quantity) AS q
  FROM lineitem GROUP BY 1, 2)
SELECT l_returnflag,
""" + ",\n".join(f"""
  round(max(a) FILTER (WHERE l_linestatus = '{s}'), 2) AS "a||{s}",
  max(q) FILTER (WHERE l_linestatus = '{s}') AS "q||{s}",
  round(max(a / q) FILTER (WHERE l_linestatus = '{s}'), 6) AS "price||{s}",
  round(max(q / a) FILTER (WHERE l_linestatus = '{s}'), 9) AS "ratio||{s}",
  round(max(a - q) FILTER (WHERE l_linestatus = '{s}'), 2) AS "less||{s}",
  round(max(a + q) FILTER (WHERE l_linestatus = '{s}'), 2) AS "plus||{s}",
  round(max(q * 2) FILTER (WHERE l_linestatus = '{s}'), 2) AS "twice||{s}" """ for s in "FO")
       + " FROM b GROUP BY 1")
def computed_measures(data: Data):
    out = pivot(data.lineitem, PivotSpec(
        rows={"l_returnflag": "l_returnflag"}, cols={"s": "l_linestatus"}, measures=[
            ["a", "l_extendedprice", "sum"], ["q", "l_quantity", "sum"],
            ["price", {"fn": "divide", "of": "a", "by": "q"}],
            ["ratio", {"fn": "rate", "events": "q", "exposed": "a"}],
            ["less", {"fn": "subtract", "from": "a", "subtract": "q"}],
            ["plus", {"fn": "add", "fields": ["a", "q"]}],
            ["twice", {"fn": "multiply", "a": "q", "by": 2}]]))
    digits = {"a": 2, "q": 2, "price": 6, "ratio": 9, "less": 2, "plus": 2, "twice": 2}
    return out.withColumns({c: F.round(F.col(f"`{c}`"), digits[c.split("||")[0]])
                            for c in out.columns if "||" in c})


@query("v9_windows_2d", """
WITH b AS (
  SELECT strftime(o_orderdate, '%Y-%m') AS month, sum(o_totalprice) FILTER (WHERE o_orderstatus = 'F') AS f,
         sum(o_totalprice) FILTER (WHERE o_orderstatus = 'O') AS o,
         sum(o_totalprice) FILTER (WHERE o_orderstatus = 'P') AS p FROM orders GROUP BY 1)
SELECT month, round(f, 2) AS "t||F", round(o, 2) AS "t||O", round(p, 2) AS "t||P",
       round((f - lag(f) OVER w) / nullif(lag(f) OVER w, 0), 4) AS "chg||F",
       round((o - lag(o) OVER w) / nullif(lag(o) OVER w, 0), 4) AS "chg||O",
       round((p - lag(p) OVER w) / nullif(lag(p) OVER w, 0), 4) AS "chg||P",
       round(f - lag(f) OVER w, 2) AS "step||F", round(o - lag(o) OVER w, 2) AS "step||O",
       round(p - lag(p) OVER w, 2) AS "step||P"
FROM b WINDOW w AS (ORDER BY month)""")
def windows_2d(data: Data):
    out = pivot(data.orders, PivotSpec(
        rows={"month": "date_format(o_orderdate, 'yyyy-MM')"}, cols={"s": "o_orderstatus"},
        measures=[["t", "o_totalprice", "sum"]],
        windows=[["chg", "t", "pct_change", "Change"], ["step", "t", "diff"]]))
    return out.withColumns({c: F.round(F.col(f"`{c}`"), 2)
                            for c in out.columns if c.startswith(("t||", "step||"))})


@query("v9_windows_1d", """
WITH b AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)
SELECT o_custkey, n, n - lag(n) OVER (ORDER BY o_custkey) AS step,
       round((n - lag(n) OVER (ORDER BY o_custkey)) / lag(n) OVER (ORDER BY o_custkey), 4) AS chg
FROM b""")
def windows_1d(data: Data):
    return pivot(data.orders, PivotSpec(
        rows={"o_custkey": "o_custkey"}, measures=[["n", "*", "count"]],
        windows=[["step", "n", "diff"], ["chg", "n", "pct_change"]]))


@query("v10_plain_pivot", """
SELECT l_linestatus, CAST(sum(l_quantity) FILTER (WHERE l_returnflag = 'A') AS BIGINT) AS "A",
       CAST(sum(l_quantity) FILTER (WHERE l_returnflag = 'N') AS BIGINT) AS "N",
       CAST(sum(l_quantity) FILTER (WHERE l_returnflag = 'R') AS BIGINT) AS "R"
FROM lineitem GROUP BY 1""")
def plain_pivot(data: Data):
    out = pivot_plain(data.lineitem, ["l_linestatus"], ["l_returnflag"], [["q", "l_quantity", "sum"]])
    return out.withColumns({c: F.col(c).cast("long") for c in "ANR"})


@query("v10_plain_pivot_two_fields", """
SELECT o_orderpriority, """ + ", ".join(
    f"count(*) FILTER (WHERE l_returnflag = '{f}' AND l_linestatus = '{s}') AS \"{f}||{s}_n\", "
    f"round(stddev_samp(l_quantity) FILTER (WHERE l_returnflag = '{f}' AND l_linestatus = '{s}'), 8) AS \"{f}||{s}_sd\""
    for f in "ANR" for s in "FO") + """
FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1""")
def plain_pivot_two_fields(data: Data):
    joined = data.lineitem.join(data.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    out = pivot_plain(joined, ["o_orderpriority"], ["l_returnflag", "l_linestatus"],
                      [["n", "*", "count"], ["sd", "l_quantity", "stddev"]])
    return out.withColumns({c: F.round(f"`{c}`", 8) for c in out.columns if c.endswith("_sd")})


CODES = {"l_quantity": "QTY", "l_extendedprice": "PRICE", "l_discount": "DISC", "l_tax": "TAX"}


@query("v11_unpivot_coded", """
SELECT l_orderkey, l_linenumber, code AS line_item_code, nullif(v, 0) AS value FROM (
  SELECT l_orderkey, l_linenumber, unnest(['QTY', 'PRICE', 'DISC', 'TAX']) AS code,
         unnest([l_quantity, l_extendedprice, l_discount, l_tax]) AS v FROM lineitem)
WHERE v <> 0""")
def unpivot_coded(data: Data):
    wide = data.lineitem.select("l_orderkey", "l_linenumber", *[
        F.nullif(F.col(c), F.lit(0.0)).alias(c) for c in CODES])
    return setops.unpivot_coded(wide, CODES)


@query("v12_unpivot", """
SELECT c_custkey, unnest(['c_nationkey', 'c_custkey']) AS variable,
       unnest([c_nationkey, c_custkey]) AS value FROM customer""")
def unpivot(data: Data):
    df = data.customer.select(
        "c_custkey", F.col("c_nationkey").cast("long").alias("nation"),
        F.col("c_custkey").alias("key"))
    return setops.unpivot(df.withColumnsRenamed({"nation": "c_nationkey"}), ["c_custkey"],
                          ["c_nationkey", "key"]).withColumn(
        "variable", F.regexp_replace("variable", "^key$", "c_custkey"))


@query("v13_bins_equal_width", """
SELECT floor(p_size / 10) * 10 AS size_bin, count(*) AS n FROM part GROUP BY 1""")
def bins_equal_width(data: Data):
    out = pivot(data.part, PivotSpec(
        rows={"size_bin": "p_size"}, measures=[["n", "*", "count"]],
        buckets={"size_bin": {"size": 10}}))
    return out.withColumn("size_bin", F.col("size_bin").cast("double"))


@query("v13_bins_edges", """
SELECT CASE WHEN p_size < 5 THEN '<5' WHEN p_size < 20 THEN '5-20' WHEN p_size < 40 THEN '20-40'
       ELSE '>=40' END AS size_bin, count(*) AS n FROM part GROUP BY 1""")
def bins_edges(data: Data):
    return pivot(data.part, PivotSpec(
        rows={"size_bin": "p_size"}, measures=[["n", "*", "count"]],
        buckets={"size_bin": {"edges": [5, 20, 40]}}))


@query("v13_bins_quantile", """
WITH q AS (SELECT quantile_cont(o_totalprice, [0.2, 0.4, 0.6, 0.8]) AS b FROM orders)
SELECT CAST(1 + (o_totalprice > b[1])::INT + (o_totalprice > b[2])::INT + (o_totalprice > b[3])::INT
         + (o_totalprice > b[4])::INT AS INTEGER) AS price_bin, count(*) AS n
FROM orders, q GROUP BY 1""")
def bins_quantile(data: Data):
    return pivot(data.orders, PivotSpec(
        rows={"price_bin": "o_totalprice"}, measures=[["n", "*", "count"]],
        buckets={"price_bin": {"count": 5}}))


@query("v14_running_sum_rank", """
WITH b AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM orders GROUP BY 1)
SELECT month, n, CAST(sum(n) OVER (ORDER BY month) AS BIGINT) AS run,
       rank() OVER (ORDER BY n) AS place FROM b""")
def running_sum_rank(data: Data):
    return pivot(data.orders, PivotSpec(
        rows={"month": "date_format(o_orderdate, 'yyyy-MM')"}, measures=[["n", "*", "count"]],
        windows=[["run", "n", "running_sum"], ["place", "n", "rank"]]))


@query("v15_column_totals_fixed_order", """
SELECT CASE WHEN grouping(o_orderpriority) = 1 THEN 'TOTAL' ELSE o_orderpriority END AS o_orderpriority,
       count(*) FILTER (WHERE o_orderstatus = 'F') AS "n||F",
       count(*) FILTER (WHERE o_orderstatus = 'O') AS "n||O",
       count(*) FILTER (WHERE o_orderstatus = 'P') AS "n||P", count(*) AS "n||TOTAL"
FROM orders GROUP BY ROLLUP (o_orderpriority)""")
def column_totals_fixed_order(data: Data):
    return pivot(data.orders, PivotSpec(
        rows={"o_orderpriority": "o_orderpriority"}, cols={"s": "o_orderstatus"},
        measures=[["n", "*", "count"]], row_totals=True, col_totals=True,
        sort={"values": ["5-LOW", "1-URGENT", "3-MEDIUM"]}))


@query("v2_wide_distinct_counts", """
SELECT CASE WHEN grouping(l_returnflag) = 1 THEN 'TOTAL' ELSE l_returnflag END AS l_returnflag,
       count(DISTINCT l_partkey) FILTER (WHERE l_linestatus = 'F') AS "parts||F",
       count(DISTINCT l_partkey) FILTER (WHERE l_linestatus = 'O') AS "parts||O"
FROM lineitem GROUP BY ROLLUP (l_returnflag)""")
def wide_distinct_counts(data: Data):
    return pivot(data.lineitem, PivotSpec(
        rows={"l_returnflag": "l_returnflag"}, cols={"s": "l_linestatus"},
        measures=[["parts", "l_partkey", "count_distinct"]], row_totals=True))


ANY_AGGREGATE = [("parts", "count(DISTINCT l_partkey)", 0), ("makers", "count(DISTINCT l_suppkey)", 0),
                 ("sd", "stddev_samp(l_extendedprice)", 6), ("v", "var_samp(l_discount)", 10),
                 ("mean", "avg(l_extendedprice)", 6), ("n", "count(*)", 0), ("top", "max(l_extendedprice)", 2)]


@query("v2_wide_any_aggregate", """
SELECT CASE WHEN grouping(l_returnflag) = 1 THEN 'TOTAL' ELSE l_returnflag END AS l_returnflag,
       CASE WHEN grouping(y) = 1 THEN 'TOTAL' ELSE y END AS y, """ + ", ".join(
    (f"round({agg}{where}, {digits})" if digits else f"{agg}{where}") + f' AS "{key}||{c}"' for key, agg, digits in ANY_AGGREGATE
    for c, where in (("F", " FILTER (WHERE l_linestatus = 'F')"), ("O", " FILTER (WHERE l_linestatus = 'O')"), ("TOTAL", ""))) + """
FROM (SELECT *, year(l_shipdate)::VARCHAR AS y FROM lineitem) GROUP BY ROLLUP (l_returnflag, y)""")
def wide_any_aggregate(data: Data):
    """Distinct counts, deviations and plain aggregates with subtotals and column totals, from one read."""
    out = pivot(data.lineitem, PivotSpec(
        rows={"l_returnflag": "l_returnflag", "y": "cast(year(l_shipdate) as string)"}, cols={"s": "l_linestatus"}, measures=[
            ["parts", "l_partkey", "count_distinct"], ["makers", "l_suppkey", "count_distinct"],
            ["sd", "l_extendedprice", "stddev"], ["v", "l_discount", "variance"], ["mean", "l_extendedprice", "avg"],
            ["n", "*", "count"], ["top", "l_extendedprice", "max"]], row_totals=True, col_totals=True))
    digits = {key: d for key, _, d in ANY_AGGREGATE if d}
    return out.withColumns({c: F.round(f"`{c}`", digits[c.split("||")[0]])
                            for c in out.columns if c.split("||")[0] in digits})


@query("v1_null_row_key", """
SELECT CASE WHEN grouping(k) = 1 THEN 'TOTAL' ELSE k END AS k, count(*) AS n
FROM (SELECT nullif(o_orderstatus, 'P') AS k FROM orders) GROUP BY ROLLUP (k)""")
def null_row_key(data: Data):
    """A NULL group stays a group of its own beside the total."""
    return pivot(data.orders, PivotSpec(
        rows={"k": "nullif(o_orderstatus, 'P')"}, measures=[["n", "*", "count"]], row_totals=True))


@query("w18_measure_windows", """
WITH b AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, sum(o_totalprice) AS t FROM orders GROUP BY 1)
SELECT month, round(t, 2) AS t, round(t - lag(t) OVER (ORDER BY month), 2) AS d,
       round((t - lag(t) OVER (ORDER BY month)) / lag(t) OVER (ORDER BY month), 4) AS pd,
       round(t / sum(t) OVER (), 6) AS s FROM b""")
def measure_windows(data: Data):
    out = pivot(data.orders, PivotSpec(
        rows={"month": "date_format(o_orderdate, 'yyyy-MM')"}, measures=[
            ["t", "o_totalprice", "sum"], ["d", {"fn": "delta", "of": "t"}],
            ["pd", {"fn": "pct_delta", "of": "t"}], ["s", {"fn": "share", "of": "t"}]]))
    return r(out, t=2, d=2, s=6)
