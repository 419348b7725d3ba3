"""Joins, lookups, enrichment, keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from starwright.functions import clean
from starwright.functions import measures as M
from starwright.operators import filters, joins
from starwright.plans import requests as R
from starwright.workload.registry import Data, query
from starwright.workload.star import dated_orders, day_dimension, star


@query("j1_equi_join", """
SELECT o_orderkey, o_totalprice, c_name, c_mktsegment
FROM orders JOIN customer ON o_custkey = c_custkey""")
def equi_join(data: Data):
    c = data.customer.withColumnRenamed("c_custkey", "o_custkey")
    return joins.join(data.orders, c, ["o_custkey"]).select(
        "o_orderkey", "o_totalprice", "c_name", "c_mktsegment")


@query("j2_lookup_enrich", """
SELECT p.*, s_name, s_acctbal FROM (SELECT l_orderkey, l_linenumber, l_suppkey FROM lineitem) p
LEFT JOIN (SELECT * FROM supplier WHERE s_acctbal > 0) ON l_suppkey = s_suppkey""")
def lookup_enrich(data: Data):
    return joins.enrich(
        data.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey"),
        data.supplier.filter("s_acctbal > 0"), ["l_suppkey=s_suppkey"], ["s_name", "s_acctbal"])


@query("j3_aggregate_enrich", """
SELECT c_custkey, c_name, n_orders, total FROM customer LEFT JOIN (
  SELECT o_custkey, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total
  FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) ON c_custkey = o_custkey""")
def aggregate_enrich(data: Data):
    return joins.aggregate_enrich(
        data.customer.select("c_custkey", "c_name"), data.orders, ("o_custkey", "c_custkey"),
        {"n_orders": "count(*)", "total": "round(sum(o_totalprice), 2)"}, "o_orderstatus = 'F'")


@query("j4_enrich_derived", """
SELECT p_partkey, coalesce(qty, 0) AS qty, coalesce(qty, 0) > 1000 AS popular FROM part LEFT JOIN (
  SELECT l_partkey, sum(l_quantity) AS qty FROM lineitem GROUP BY 1) ON p_partkey = l_partkey""")
def enrich_derived(data: Data):
    return joins.aggregate_enrich(
        data.part.select("p_partkey"), data.lineitem, ("l_partkey", "p_partkey"),
        {"sold": "sum(l_quantity)"},
        derived={"qty": "coalesce(sold, 0D)", "popular": "coalesce(sold, 0D) > 1000"},
    ).drop("sold")


@query("j5_auto_join", """
SELECT r_name, p_brand, round(sum(l_quantity), 2) AS l_quantity
FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
GROUP BY 1, 2""")
def auto_join(data: Data):
    # the nearest way from line items to regions leads over suppliers
    return R.chart(star(data), "geo.r_name", "sales.l_quantity", "goods.p_brand", "sum")


@query("j5_two_roles", """
SELECT cn.n_name AS dim_customer_n_name, sn.n_name AS dim_supplier_n_name, round(sum(l_extendedprice), 2) AS l_extendedprice
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
JOIN supplier ON l_suppkey = s_suppkey JOIN nation cn ON c_nationkey = cn.n_nationkey
JOIN nation sn ON s_nationkey = sn.n_nationkey GROUP BY 1, 2""")
def two_roles(data: Data):
    """Trade between nations: the one of the customer and the one of the supplier."""
    out = R.chart(star(data), "geo.n_name@dim_customer", "sales.l_extendedprice", "geo.n_name@dim_supplier", "sum")
    return out.withColumn("l_extendedprice", F.round("l_extendedprice", 2))


@query("j15_role_hops", """
SELECT cr.r_name AS buyer, sr.r_name AS seller, count(*) AS n, max(l_quantity) AS most
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
JOIN supplier ON l_suppkey = s_suppkey JOIN nation cn ON c_nationkey = cn.n_nationkey
JOIN nation sn ON s_nationkey = sn.n_nationkey JOIN region cr ON cn.n_regionkey = cr.r_regionkey
JOIN region sr ON sn.n_regionkey = sr.r_regionkey
WHERE cr.r_name <> sr.r_name AND cn.n_name <> 'NATION_3' GROUP BY 1, 2""")
def role_hops(data: Data):
    """Regions two hops behind their roles, filtered in one role only."""
    out = R.flat_table(star(data), [
        ["buyer", "geo.r_name@dim_customer"], ["seller", "geo.r_name@dim_supplier"],
        ["n", "sales.l_orderkey", "count"], ["most", "sales.l_quantity", "max"]],
        filters=[{"field": "geo.n_name@dim_customer", "op": "in",
                  "value": [f"NATION_{i}" for i in range(25) if i != 3]}])
    return out.filter("buyer <> seller")


@query("a12_early_groups", """
SELECT c_mktsegment, p_brand, round(sum(l_extendedprice), 2) AS total, count(*) AS n, max(l_quantity) AS most
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey
WHERE o_orderstatus = 'F' AND l_discount > 0.02 GROUP BY 1, 2""")
def early_groups(data: Data):
    """Line items are aggregated by (order, part) before they meet the other tables."""
    out = star(data).aggregated(
        {"c_mktsegment": "parties.c_mktsegment", "p_brand": "goods.p_brand"},
        [M.Measure("total", "sales.l_extendedprice", "sum"), M.Measure("n", "sales.l_orderkey", "count"),
         M.Measure("most", "sales.l_quantity", "max")],
        [{"field": "sales.o_orderstatus", "op": "eq", "value": "F"}, {"field": "sales.l_discount", "op": "gte", "value": 0.021}],
        early=True)
    return out.withColumn("total", F.round("total", 2))


@query("j7_domain_scope", """
SELECT c_mktsegment, count(*) AS customers FROM customer GROUP BY 1""")
def domain_scope(data: Data):
    """A filter on sales is out of reach of a request on parties only, and is skipped."""
    return R.flat_table(star(data), [
        ["c_mktsegment", "parties.c_mktsegment"],
        ["customers", "parties.c_custkey", "count"],
    ], filters=[{"field": "sales.o_orderstatus", "op": "eq", "value": "F"}])


@query("j8_left_anti", """
SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)""")
def left_anti(data: Data):
    keys = data.lineitem.select(F.col("l_orderkey").alias("o_orderkey"))
    return joins.join(data.orders, keys, ["o_orderkey"], "left_anti").select("o_orderkey")


@query("j9_key_repair", """
SELECT o_orderkey, c_custkey AS company_id FROM orders
LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey""")
def key_repair(data: Data):
    broken = data.orders.select("o_orderkey", F.concat(F.lit("C-"), "o_custkey").alias("cik"),
                                F.lit(-1).cast("long").alias("company_id"))
    dim = data.customer.filter("c_acctbal > 0").select(
        F.concat(F.lit("C-"), "c_custkey").alias("company_cik"), "c_custkey")
    return joins.repair_key(broken, dim, ("cik", "company_cik"), "company_id", "c_custkey").select(
        "o_orderkey", "company_id")


@query("j9_match_rate", """
SELECT count(*) AS total_rows, count(c_custkey) AS matched_rows,
       count(c_custkey) / count(*) AS match_rate FROM orders
LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey""")
def match_rate(data: Data):
    return joins.match_rate(key_repair(data), "company_id")


@query("j10_enriched_view", """
SELECT l_orderkey, l_linenumber, o_orderdate::DATE AS order_date, p_brand, s_name
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
LEFT JOIN part ON l_partkey = p_partkey LEFT JOIN supplier ON l_suppkey = s_suppkey
WHERE o_orderstatus = 'O'""")
def enriched_view(data: Data):
    edges = [joins.edge("fact_lineitem", "fact_orders", "l_orderkey=o_orderkey"),
             joins.edge("fact_lineitem", "dim_part", "l_partkey=p_partkey", optional=True),
             joins.edge("fact_lineitem", "dim_supplier", "l_suppkey=s_suppkey", optional=True)]
    df = joins.star_join({
        "fact_lineitem": data.lineitem, "fact_orders": data.orders,
        "dim_part": data.part, "dim_supplier": data.supplier}, edges)
    return df.filter("o_orderstatus = 'O'").select(
        "l_orderkey", "l_linenumber", F.col("o_orderdate").cast("date").alias("order_date"),
        "p_brand", "s_name")


@query("j11_fan_out", """
WITH r AS (SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY 1)
SELECT count(*) AS rows_before, CAST(sum(coalesce(n, 0)) AS BIGINT) AS rows_after,
       max(n) AS max_matches, sum(coalesce(n, 0)) > count(*) AS explodes
FROM orders LEFT JOIN r ON o_orderkey = k""")
def fan_out(data: Data):
    return joins.fan_out(data.orders, data.lineitem, ("o_orderkey", "l_orderkey"))


@query("j12_checked_broadcast", """
SELECT n_name, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey
GROUP BY 1""")
def checked_broadcast(data: Data):
    nation = joins.broadcast_if_small(data.nation)
    return data.customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).groupBy(
        "n_name").agg(F.count(F.lit(1)).alias("customers"))


@query("j13_optional_edges", """
SELECT o_orderkey, c_mktsegment FROM orders
LEFT JOIN (SELECT * FROM customer WHERE c_mktsegment <> 'BUILDING') ON o_custkey = c_custkey""")
def optional_edges(data: Data):
    edges = [joins.edge("fact_orders", "dim_customer", "o_custkey=c_custkey", optional=True)]
    return joins.star_join({
        "fact_orders": data.orders,
        "dim_customer": data.customer.filter("c_mktsegment <> 'BUILDING'")}, edges,
    ).select("o_orderkey", "c_mktsegment")


@query("j14_auto_edges", """
SELECT year(o_orderdate)::INTEGER AS year, count(*) AS orders FROM orders GROUP BY 1""")
def auto_edges(data: Data):
    tables = {"fact_orders": dated_orders(data), "dim_calendar": day_dimension(data)}
    found = joins.auto_edges(tables, [("date_id", "dim_calendar", "date_id"),
                                      ("location_id", "dim_location", "location_id")])
    return joins.star_join(tables, found).groupBy("dim_calendar.year").agg(
        F.count(F.lit(1)).alias("orders"))


@query("j15_named_path", """
SELECT n_name, count(*) AS lines FROM lineitem JOIN orders ON l_orderkey = o_orderkey
JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1""")
def named_path(data: Data):
    c = star(data)
    return joins.star_join(
        c.tables, c.edges, ["fact_lineitem", "dim_nation"],
        path=["fact_lineitem", "fact_orders", "dim_customer", "dim_nation"],
    ).groupBy("n_name").agg(F.count(F.lit(1)).alias("lines"))


@query("j16_latest_enrich", """
SELECT c_custkey, latest_total, latest_total * c_nationkey AS scaled FROM customer LEFT JOIN (
  SELECT o_custkey, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS latest_total
  FROM orders GROUP BY 1) ON c_custkey = o_custkey""")
def latest_enrich(data: Data):
    return joins.latest_enrich(
        data.customer.select("c_custkey", "c_nationkey"), data.orders, ("o_custkey", "c_custkey"),
        {"latest_total": "o_totalprice"}, ["o_orderdate", "o_orderkey"],
        {"scaled": "latest_total * c_nationkey"},
    ).select("c_custkey", "latest_total", "scaled")


@query("j17_parent_keys", """
WITH g AS (
  SELECT 'R' || r_regionkey AS geo, r_regionkey AS code, TRUE AS top FROM region
  UNION ALL SELECT 'N' || n_nationkey, n_regionkey, FALSE FROM nation
  UNION ALL SELECT 'C' || c_custkey, c_nationkey % 5, FALSE FROM customer)
SELECT g.geo, CASE WHEN NOT g.top THEN p.geo END AS parent_key
FROM g LEFT JOIN (SELECT * FROM g WHERE top) p ON g.code = p.code""")
def parent_keys(data: Data):
    key = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string")).alias("geo")
    rows = (
        data.region.select(key("R", "r_regionkey"), F.col("r_regionkey").alias("code"),
                           F.lit(True).alias("top"))
        .unionByName(data.nation.select(key("N", "n_nationkey"), F.col("n_regionkey").alias("code"),
                                        F.lit(False).alias("top")))
        .unionByName(data.customer.select(key("C", "c_custkey"), (F.col("c_nationkey") % 5).alias("code"),
                                          F.lit(False).alias("top"))))
    return joins.parent_keys(rows, "geo", "code", "top").select("geo", "parent_key")


@query("f10_unreachable_filter", """
SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1""")
def unreachable_filter(data: Data):
    return R.flat_table(
        star(data), [["n_name", "geo.n_name"], ["n", "parties.c_custkey", "count"]],
        filters=[{"field": "sales.o_totalprice", "op": "gte", "value": 1e9},
                 {"field": "nowhere.x", "op": "eq", "value": 1}])


@query("f11_context_filters", """
SELECT value, round(sort_value, 4) AS sort_value FROM (
  SELECT n_name AS value, avg(c_acctbal) AS sort_value
  FROM customer JOIN nation ON c_nationkey = n_nationkey
  WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND n_regionkey = 1 GROUP BY 1)""")
def context_filters(data: Data):
    out = R.value_list(star(data), "geo.n_name", "parties.c_acctbal", context=[
        ("parties.c_mktsegment", ["BUILDING", "MACHINERY"]), ("geo.n_regionkey", 1),
        ("parties.c_mktsegment", [])])
    return out.withColumn("sort_value", F.round("sort_value", 4))


@query("f14_recipe_filters", """
SELECT l_orderkey, l_linenumber, l_quantity AS qty FROM lineitem
WHERE l_linestatus = 'F' AND l_quantity > 45""")
def recipe_filters(data: Data):
    from starwright.plans.recipes import standard_table

    return standard_table(
        filters.where_all(data.lineitem, ["l_linestatus = 'F'"]), ["l_quantity > 45"],
        select={"l_orderkey": "l_orderkey", "l_linenumber": "l_linenumber", "qty": "l_quantity"})


@query("p18_key_join", """
SELECT count(*) AS matched, round(sum(o_totalprice), 2) AS total FROM orders""")
def key_join(data: Data):
    """Surrogate keys made on both sides meet again in a join."""
    dim = data.customer.select(clean.surrogate_key(F.concat(F.lit("c"), "c_custkey")).alias("id"))
    fact = data.orders.select(
        clean.surrogate_key(F.concat(F.lit("c"), "o_custkey")).alias("id"), "o_totalprice")
    return fact.join(dim, "id").agg(F.count(F.lit(1)).alias("matched"),
                                    F.round(F.sum("o_totalprice"), 2).alias("total"))
