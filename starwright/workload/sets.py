"""Sort, limit, union, dedup, distinct dimensions, value lists, quality reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from starwright.operators import quality, setops
from starwright.plans import requests as R
from starwright.workload.aggregates import r
from starwright.workload.registry import Data, query
from starwright.workload.star import star


@query("o1_sort", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey")
def sort(data: Data):
    return R.ordered(data.customer.select("c_custkey", "c_acctbal"),
                     {"by": "c_acctbal", "order": "desc"}, ["c_custkey"])


@query("o2_row_cap", """
SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100""")
def row_cap(data: Data):
    return setops.top_n(data.orders.select("o_orderkey", "o_totalprice"), "o_totalprice", 100, "o_orderkey")


@query("o3_byte_cap", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY 1, 2")
def byte_cap(data: Data):
    """A report far below the cap is kept whole."""
    report = data.lineitem.groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))
    return setops.capped_by_bytes(report, 4 * 1024 * 1024, ["l_returnflag", "l_linestatus"])


@query("o3_byte_cap_cuts", """
WITH lines AS (SELECT o_orderkey, o_orderpriority, o_totalprice,
  strlen('{"o_orderkey":' || o_orderkey || ',"o_orderpriority":"' || o_orderpriority || '"}') + 1 AS n FROM orders),
summed AS (SELECT *, sum(n) OVER (ORDER BY o_totalprice DESC, o_orderkey) AS upto FROM lines)
SELECT o_orderkey, o_orderpriority FROM summed WHERE upto <= 32768""")
def byte_cap_cuts(data: Data):
    """The dearest orders as far as 32 KiB of JSON reach: a cut in the middle of the report."""
    return setops.capped_by_bytes(data.orders, 32 * 1024, [F.desc("o_totalprice"), "o_orderkey"],
                                  ["o_orderkey", "o_orderpriority"])


@query("o4_top_entities", """
WITH last AS (
  SELECT o_custkey, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS score FROM orders GROUP BY 1),
best AS (SELECT o_custkey FROM last ORDER BY score DESC, o_custkey LIMIT 20)
SELECT o_custkey, o_orderkey FROM orders WHERE o_custkey IN (SELECT o_custkey FROM best)""")
def top_entities(data: Data):
    keyed = data.orders.withColumn("at", F.struct("o_orderdate", "o_orderkey"))
    return setops.top_entities_latest(keyed, "o_custkey", "at", "o_totalprice", 20).select(
        "o_custkey", "o_orderkey")


@query("o5_top_stored", """
SELECT c_name, c_acctbal FROM customer WHERE c_acctbal > 0 AND c_mktsegment <> 'BUILDING'
AND NOT regexp_matches(upper(c_name), '0$') ORDER BY c_acctbal DESC, c_name LIMIT 25""")
def top_stored(data: Data):
    from starwright.operators.filters import not_matching, real_number

    fit = data.customer.filter(real_number("c_acctbal") & not_matching("c_name", ["0$"])).filter(
        "c_mktsegment <> 'BUILDING'")
    one = setops.keep_one(fit.select("c_name", "c_acctbal"), ["c_name"], ["c_acctbal"], latest=True)
    return setops.top_n(one, "c_acctbal", 25, "c_name")


@query("o6_union_by_name", """
SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment, CAST(NULL AS DOUBLE) AS balance FROM customer
UNION ALL SELECT s_suppkey, s_name, NULL, s_acctbal FROM supplier""")
def union_by_name(data: Data):
    a = data.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"),
                             F.col("c_mktsegment").alias("segment"))
    b = data.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"),
                             F.col("s_acctbal").alias("balance"))
    return setops.union([a, b])


@query("o7_source_union", """
SELECT 'customer' AS domain_source, 'party' AS entry_type, c_custkey AS id, 'BALANCE' AS code,
       c_acctbal AS value, c_acctbal > 0 AS positive FROM customer
UNION ALL SELECT 'supplier', 'party', s_suppkey, 'NATION', s_nationkey::DOUBLE, s_nationkey > 0 FROM supplier
UNION ALL SELECT 'supplier', 'party', s_suppkey, 'BALANCE', s_acctbal, s_acctbal > 0 FROM supplier""")
def source_union(data: Data):
    shape = {"id": "id", "code": "line_item_code", "value": "value"}
    return setops.union_sources([
        {"df": data.customer.select(F.col("c_custkey").alias("id"), "c_acctbal"),
         "unpivot": {"c_acctbal": "BALANCE"}, "select": shape,
         "domain_source": "customer", "entry_type": "party"},
        {"df": data.supplier.select(F.col("s_suppkey").alias("id"), "s_nationkey", "s_acctbal"),
         "unpivot": {"s_nationkey": "NATION", "s_acctbal": "BALANCE"}, "select": shape,
         "domain_source": "supplier", "entry_type": "party"},
        {"df": lambda: data.spark.read.parquet(data.path("no_such_table")), "domain_source": "gone"},
    ], derived={"positive": "value > 0"}, dedup_keys=["domain_source", "id", "code"])


@query("o8_federated_union", """
SELECT 'buyers' AS domain_source, c_nationkey AS nation, count(*) AS n FROM customer GROUP BY 2
UNION ALL SELECT 'sellers', s_nationkey, count(*) FROM supplier GROUP BY 2""")
def federated_union(data: Data):
    both = setops.federated_union({
        "buyers": data.customer.select(F.col("c_nationkey").alias("nation")),
        "sellers": data.supplier.select(F.col("s_nationkey").alias("nation"))})
    return both.groupBy("domain_source", "nation").agg(F.count(F.lit(1)).alias("n"))


@query("o9_dedup", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
    ORDER BY l_partkey, l_suppkey, l_quantity) AS n FROM lineitem) WHERE n = 1""")
def dedup(data: Data):
    return setops.keep_one(data.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"),
        ["l_orderkey", "l_linenumber"])


@query("o10_distinct_dimension", """
WITH u AS (SELECT c_nationkey AS nation, c_acctbal AS balance FROM customer
           UNION ALL SELECT s_nationkey, s_acctbal FROM supplier)
SELECT nation, min(balance) AS balance, 'N' || nation AS code FROM u GROUP BY 1""")
def distinct_dimension(data: Data):
    return setops.distinct_dimension(
        [data.customer.select(F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance")),
         data.supplier.select(F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance"))],
        ["nation"], ["balance"], {"code": "concat('N', nation)"})


@query("o11_value_list", "SELECT DISTINCT p_brand AS value FROM part WHERE p_brand IS NOT NULL")
def value_list(data: Data):
    return R.value_list(star(data), "goods.p_brand")


@query("o12_values_by_measure", """
SELECT p_brand AS value, round(avg(l_quantity), 6) AS sort_value
FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size = 10 GROUP BY 1""")
def values_by_measure(data: Data):
    out = R.value_list(star(data), "goods.p_brand", "sales.l_quantity", context=[("goods.p_size", 10)])
    return r(out, sort_value=6)


# -- data quality ----------------------------------------------------------------------


def event_checks() -> quality.Checks:
    return quality.Checks(
        required=["event_id", "ts", "user_id", "price"], optional=["session"], numeric=["value", "event_type"],
        ranges={"value": (5, 100)}, date="day", entity="event_type")


@query("d1_required_columns", """
SELECT 'error' AS level, 'missing required column price' AS message
UNION ALL SELECT 'warning', 'missing optional column session'
UNION ALL SELECT 'info', 'rows ' || count(*) FROM events""")
def required_columns(data: Data):
    rep = quality.report(data.events, event_checks())
    issues = rep.filter("kind = 'issue'").select("level", "message")
    n = rep.filter("item = 'row_count'").select(
        F.lit("info").alias("level"), F.concat(F.lit("rows "), F.col("value").cast("long")).alias("message"))
    return issues.unionByName(n)


@query("d2_to_d8_report", """
WITH e AS (SELECT *, ts::DATE AS day, CASE WHEN event_type <> 'error' THEN value END AS v FROM events)
SELECT 'issue' AS kind, 'error' AS level, 'coverage' AS category, 'rows' AS item, count(*)::DOUBLE AS value FROM e
UNION ALL SELECT 'issue', 'error', 'type', 'event_type', NULL
UNION ALL SELECT 'issue', 'warning', 'range', 'v', min(v) FROM e HAVING min(v) < 5
UNION ALL SELECT 'issue', 'warning', 'range', 'v', max(v) FROM e HAVING max(v) > 20
UNION ALL SELECT 'issue', 'warning', 'quality', 'v', round(1 - count(v) / count(*), 6) FROM e
UNION ALL SELECT 'metric', 'info', 'metric', 'row_count', count(*)::DOUBLE FROM e
UNION ALL SELECT 'metric', 'info', 'metric', 'column_count', 8
UNION ALL SELECT 'metric', 'info', 'metric', 'v_mean', round(avg(v), 6) FROM e
UNION ALL SELECT 'metric', 'info', 'metric', 'v_std', round(stddev_samp(v), 6) FROM e
UNION ALL SELECT 'metric', 'info', 'metric', 'v_min', min(v) FROM e
UNION ALL SELECT 'metric', 'info', 'metric', 'v_max', max(v) FROM e
UNION ALL SELECT 'metric', 'info', 'metric', 'unique_dates', count(DISTINCT day)::DOUBLE FROM e
UNION ALL SELECT 'metric', 'info', 'metric', 'entity_count', count(DISTINCT event_type)::DOUBLE FROM e
UNION ALL SELECT 'metric', 'info', 'metric', 'date_range', NULL""")
def full_report(data: Data):
    events = data.events.withColumn("day", F.col("ts").cast("date")).withColumn(
        "v", F.when(F.col("event_type") != "error", F.col("value")))
    out = quality.report(events, quality.Checks(
        required=["event_id", "v"], numeric=["v", "event_type"], ranges={"v": (5, 20)},
        null_shares={"v": 0.1}, min_rows=10**12, date="day", entity="event_type"))
    return out.select("kind", "level", "category", "item", (F.round("value", 6)).alias("value"))


@query("d5_null_shares", """
WITH e AS (SELECT nullif(o_orderstatus, 'P') AS s, o_totalprice AS t FROM orders)
SELECT 's' AS "column", count(*) AS rows, count(*) - count(s) AS null_rows, (count(*) - count(s)) / count(*) AS null_share FROM e
UNION ALL SELECT 't', count(*), count(*) - count(t), (count(*) - count(t)) / count(*) FROM e""")
def null_shares(data: Data):
    return quality.null_shares(data.orders.select(
        F.nullif("o_orderstatus", F.lit("P")).alias("s"), F.col("o_totalprice").alias("t")))


@query("d6_time_coverage", """
SELECT min(o_orderdate)::DATE AS min_date, max(o_orderdate)::DATE AS max_date,
       count(DISTINCT o_orderdate::DATE) AS unique_dates, count(DISTINCT o_custkey) AS entity_count FROM orders""")
def time_coverage(data: Data):
    return quality.time_coverage(
        data.orders.withColumn("day", F.col("o_orderdate").cast("date")), "day", "o_custkey")


@query("d9_duplicate_keys", """
SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1
""")
def duplicate_keys(data: Data):
    return quality.duplicate_keys(data.lineitem, ["l_orderkey", "l_linenumber"])


@query("d10_table_stats", """
SELECT 'lineitem' AS table_name, count(*) AS rows, 11 AS columns FROM lineitem
UNION ALL SELECT 'orders', count(*), 6 FROM orders UNION ALL SELECT 'customer', count(*), 5 FROM customer
UNION ALL SELECT 'documents', count(*), 5 FROM documents UNION ALL SELECT 'events', count(*), 6 FROM events""")
def table_stats(data: Data):
    return quality.table_stats({n: getattr(data, n) for n in
                                ("lineitem", "orders", "customer", "documents", "events")})


@query("d11_population", """
SELECT count(*) AS total, count(quality) AS with_quality, count(toxic) AS with_toxic, count(lang) AS with_lang
FROM documents LEFT JOIN labels USING (doc_id)""")
def population(data: Data):
    df = data.documents.select("doc_id", "lang").join(data.labels, "doc_id", "left")
    return quality.population(df, ["quality", "toxic", "lang"])


@query("d12_key_match", """
SELECT count(*) AS total_rows, count(quality) AS matched_rows, count(quality) / count(*) AS match_rate
FROM documents LEFT JOIN labels USING (doc_id)""")
def key_match(data: Data):
    from starwright.operators.joins import match_rate

    return match_rate(data.documents.select("doc_id").join(data.labels, "doc_id", "left"), "quality")
