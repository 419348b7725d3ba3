"""Projection, cleaning and keys (whole tables, one query per operator)."""

from __future__ import annotations

from pyspark.sql import functions as F

from starwright.functions import clean
from starwright.operators import filters, projection
from starwright.workload.registry import Data, query
from starwright.workload.star import BARS_SQL, daily_bars


@query("p1_select", "SELECT o_orderkey, o_totalprice FROM orders")
def select(data: Data):
    return projection.select(data.orders, ["o_orderkey", "o_totalprice"])


@query("p2_drop", "SELECT c_custkey, c_nationkey, c_mktsegment FROM customer")
def drop(data: Data):
    return projection.drop(data.customer, ["c_name", "c_acctbal", "no_such_column"])


@query("p3_derive", """
SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net,
       l_extendedprice * (1 - l_discount) * (1 + l_tax) AS gross FROM lineitem""")
def derive(data: Data):
    out = projection.derive(data.lineitem, {
        "net": "l_extendedprice * (1 - l_discount)", "gross": "net * (1 + l_tax)"})
    return out.select("l_orderkey", "l_linenumber", "net", "gross")


@query("p4_select_map", """
SELECT p_brand AS p_type, p_type AS p_brand, p_size + 1 AS p_size, p_size AS old_size FROM part""")
def select_map(data: Data):
    return projection.select_map(data.part, {
        "p_type": "p_brand", "p_brand": "p_type", "p_size": "p_size + 1", "old_size": "p_size"})


@query("p5_rename", "SELECT s_suppkey AS id, s_name AS name, s_nationkey, s_acctbal FROM supplier")
def rename(data: Data):
    return projection.rename_present(
        data.supplier, {"s_suppkey": "id", "s_name": "name", "missing": "other"})


RAW_VALUE = """CASE event_type WHEN 'error' THEN 'bad' WHEN 'view' THEN 'NaN'
       ELSE CAST(value AS VARCHAR) END"""


def _text_value():
    kind = F.col("event_type")
    return (F.when(kind == "error", "bad").when(kind == "view", "NaN")
            .otherwise(F.col("value").cast("string")))


@query("p6_coerce", """
SELECT event_id, CASE WHEN event_type NOT IN ('error', 'view') THEN value END AS amount,
       event_type = 'view' AS not_a_number FROM events""")
def coerce(data: Data):
    raw = data.events.select("event_id", "event_type", _text_value().alias("amount"))
    out = projection.coerce(raw, {"amount": "int"})
    nan = F.isnan(F.coalesce("amount", F.lit(0.0)))
    return out.select("event_id", F.when(~nan, F.col("amount")).alias("amount"), nan.alias("not_a_number"))


@query("p7_integer_via_double", """
SELECT event_id, CASE WHEN event_type IN ('error', 'view') THEN NULL
       ELSE CAST(trunc(value) AS INTEGER) END AS whole FROM events""")
def integer_via_double(data: Data):
    return data.events.select("event_id", clean.to_integer(_text_value()).alias("whole"))


@query("p8_null_tokens", """
SELECT o_orderkey, CASE WHEN o_orderpriority IN ('5-LOW', '2-HIGH', '1-URGENT') THEN NULL
       ELSE o_orderpriority END AS priority FROM orders""")
def null_tokens(data: Data):
    p = F.col("o_orderpriority")
    raw = (F.when(p == "5-LOW", " N/A").when(p == "2-HIGH", " - ").when(p == "1-URGENT", "  ")
           .otherwise(F.concat(F.lit(" "), p, F.lit(" "))))
    return data.orders.select("o_orderkey", clean.blank_to_null(raw).alias("priority"))


def _broken_date(text):
    s = F.col("o_orderstatus")
    return F.when(s == "F", "None").when(s == "P", "0000-00-00").otherwise(text)


@query("p9_parse_date", """
SELECT o_orderkey, CASE WHEN o_orderstatus IN ('F', 'P') THEN NULL
       ELSE CAST(o_orderdate AS DATE) END AS day FROM orders""")
def parse_date(data: Data):
    return data.orders.select("o_orderkey", clean.to_date(
        _broken_date(F.date_format("o_orderdate", "yyyy-MM-dd"))).alias("day"))


@query("p10_parse_timestamp", """
SELECT o_orderkey, CASE WHEN o_orderstatus IN ('F', 'P') THEN NULL
       ELSE strftime(o_orderdate + INTERVAL 90 MINUTE, '%Y-%m-%d %H:%M') END AS at FROM orders""")
def parse_timestamp(data: Data):
    text = F.date_format(F.col("o_orderdate") + F.expr("INTERVAL 90 MINUTE"), "yyyy-MM-dd HH:mm:ss")
    parsed = clean.to_timestamp(_broken_date(text))
    return data.orders.select("o_orderkey", F.date_format(parsed, "yyyy-MM-dd HH:mm").alias("at"))


def _mixed_formats():
    """The order date in one of the formats met in feeds, by order priority."""
    p, d = F.substring("o_orderpriority", 1, 1), F.col("o_orderdate")
    return (
        F.when(p == "1", F.date_format(d, "yyyy-MM-dd'T'HH:mm:ss.SSS"))
        .when(p == "2", F.date_format(d, "M/d/yyyy"))
        .when(p == "3", F.date_format(d, "MMMM dd yyyy"))
        .when(p == "4", F.concat(F.lit(" "), F.date_format(d, "yyyy-MM-dd"), F.lit(" ")))
        .otherwise(F.date_format(d, "yyyy")))


@query("p11_parse_date_any", """
SELECT o_orderkey, CASE WHEN left(o_orderpriority, 1) = '5' THEN make_date(year(o_orderdate), 1, 1)
       ELSE CAST(o_orderdate AS DATE) END AS day FROM orders""")
def parse_date_any(data: Data):
    return data.orders.select("o_orderkey", clean.to_date_any(_mixed_formats()).alias("day"))


@query("p12_parse_timestamp_any", """
SELECT o_orderkey, CASE left(o_orderpriority, 1)
         WHEN '5' THEN strftime(o_orderdate, '%Y-01-01 00:00:00')
         WHEN '3' THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END AS at
FROM orders""")
def parse_timestamp_any(data: Data):
    at = clean.to_timestamp_any(_mixed_formats())
    return data.orders.select("o_orderkey", F.date_format(at, "yyyy-MM-dd HH:mm:ss").alias("at"))


@query("p13_year_column", """
SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 1900
       ELSE year(o_orderdate) END::INTEGER AS year FROM orders""")
def year_column(data: Data):
    given = data.orders.withColumn("year", F.when(F.col("o_orderstatus") == "F", 1900))
    return given.select("o_orderkey", clean.year_or_date("year", "o_orderdate").alias("year"))


@query("p14_computed_default", """
SELECT p_partkey, p_size * 2 AS twice, 7.5::DOUBLE AS fallback FROM part""")
def computed_default(data: Data):
    out = projection.computed(data.part, "twice", "p_size * 2", "int")
    out = projection.computed(out, "fallback", "no_such_column * 2", "double", 7.5)
    return out.select("p_partkey", "twice", "fallback")


@query("p15_load_metadata", """
SELECT count(*) AS total, count(*) AS stamped, count(*) AS dated, 'feed' AS origin FROM customer""")
def load_metadata(data: Data):
    out = projection.with_load_metadata(data.customer, {"origin": "feed"})
    return out.agg(F.count(F.lit(1)).alias("total"), F.count("ingestion_timestamp").alias("stamped"),
                   F.count("snapshot_date").alias("dated"), F.max("origin").alias("origin"))


@query("p16_conform", """
SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, CAST(NULL AS DOUBLE) AS score,
       c_nationkey::BIGINT AS c_nationkey FROM customer""")
def conform(data: Data):
    return projection.conform(data.customer, [
        ("c_custkey", "string"), ("score", "double"), ("c_nationkey", "long")])


@query("p17_discriminators", """
SELECT o_orderkey, 'sales' AS domain_source, 'order' AS entry_type FROM orders""")
def discriminators(data: Data):
    return projection.with_constants(data.orders.select("o_orderkey"), {
        "domain_source": "sales", "entry_type": "order"})


@query("p18_surrogate_key", """
SELECT count(*) AS total, count(DISTINCT c_name) AS keys_64, 0::BIGINT AS negative FROM customer""")
def surrogate_key(data: Data):
    keyed = data.customer.select(clean.surrogate_key("c_name").alias("k64"))
    return keyed.agg(F.count(F.lit(1)).alias("total"), F.count_distinct("k64").alias("keys_64"),
                     F.count_if(F.col("k64") < 0).alias("negative"))


@query("p18_key_parts", """
WITH parts AS (
  SELECT p_brand || '_' || p_size AS a, nullif(p_type, '') AS b FROM part
  UNION ALL SELECT p_brand, p_size || '_' || p_type FROM part
  UNION ALL SELECT p_brand || '_' || p_size || '_' || p_type, NULL FROM part)
SELECT count(*) AS total, count(DISTINCT {'a': a, 'b': b}) AS keys_64 FROM parts""")
def key_parts(data: Data):
    """Parts cut at different places give different keys."""
    size, joined = F.col("p_size").cast("string"), F.concat_ws("_", "p_brand", "p_size")
    pairs = [(joined, F.col("p_type")), (F.col("p_brand"), F.concat_ws("_", size, "p_type")),
             (F.concat_ws("_", joined, "p_type"), F.lit(None).cast("string"))]
    keys = [data.part.select(clean.surrogate_key(a, b).alias("k")) for a, b in pairs]
    return keys[0].unionByName(keys[1]).unionByName(keys[2]).agg(
        F.count(F.lit(1)).alias("total"), F.count_distinct("k").alias("keys_64"))


@query("p19_date_key", """
SELECT o_orderkey, CAST(strftime(o_orderdate, '%Y%m%d') AS INTEGER) AS date_id,
       CAST(strftime(o_orderdate, '%Y%m%d') AS INTEGER) AS date_id_text,
       year(o_orderdate)::INTEGER AS year FROM orders""")
def date_key(data: Data):
    out = data.orders.select(
        "o_orderkey", clean.date_key("o_orderdate").alias("date_id"),
        clean.date_key_of_text(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("date_id_text"))
    return out.withColumn("year", clean.year_of_key("date_id"))


@query("p20_padded_id", "SELECT lpad(CAST(p_partkey AS VARCHAR), 14, '0') AS pin FROM part")
def padded_id(data: Data):
    return data.part.select(clean.padded_id("p_partkey").alias("pin"))


@query("p21_split_ratio", """
SELECT l_orderkey, l_linenumber, round(l_quantity / nullif(l_discount, 0), 4) AS ratio
FROM lineitem""")
def split_ratio(data: Data):
    return data.lineitem.select(
        "l_orderkey", "l_linenumber",
        F.round(clean.safe_ratio("l_quantity", "l_discount"), 4).alias("ratio"))


@query("p22_geometry_text", """
SELECT c_custkey, '{"type":"Point","x":' || c_custkey || ',"y":' || c_nationkey || '}' AS geo
FROM customer""")
def geometry_text(data: Data):
    point = F.struct(F.lit("Point").alias("type"), F.col("c_custkey").alias("x"),
                     F.col("c_nationkey").alias("y"))
    return data.customer.select("c_custkey", clean.geometry_text(point).alias("geo"))


@query("p23_category", """
SELECT p_partkey, CASE WHEN p_type IN ('PROMO', 'ECONOMY') THEN 'cheap'
       WHEN p_name LIKE '%bolt' THEN 'bolt' WHEN p_size BETWEEN 10 AND 20 THEN 'medium'
       ELSE 'other' END AS category FROM part""")
def category(data: Data):
    return data.part.select("p_partkey", clean.category([
        (F.col("p_type").isin("PROMO", "ECONOMY"), "cheap"), ("p_name LIKE '%bolt'", "bolt"),
        (F.col("p_size").between(10, 20), "medium")], "other").alias("category"))


@query("p24_endpoint_fields", f"""
WITH {BARS_SQL}
SELECT ticker, trade_date, (high + low + close) / 3 AS typical,
       year(trade_date)::INTEGER AS year, month(trade_date)::INTEGER AS month,
       volume - abs(open) AS free, close > open AS beaten FROM bars""")
def endpoint_fields(data: Data):
    out = projection.derive(daily_bars(data), {
        "typical": "(high + low + close) / 3", "year": "year(trade_date)",
        "month": "month(trade_date)", "free": "volume - abs(open)",
        "beaten": "close > open"})
    return out.select("ticker", "trade_date", "typical", "year", "month", "free", "beaten")


@query("p25_epoch_date", """
SELECT event_id, CAST(ts AS DATE) AS from_seconds, CAST(ts AS DATE) AS from_millis FROM events""")
def epoch_date(data: Data):
    seconds = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    out = data.events.select("event_id", seconds.alias("s"))
    return out.select("event_id", clean.epoch_date("s").alias("from_seconds"),
                      clean.epoch_date(F.col("s") * 1000, "ms").alias("from_millis"))


@query("p26_band", """
SELECT event_id, CASE WHEN value < 5 THEN 'cold' WHEN value < 15 THEN 'mild' ELSE 'warm' END AS band
FROM events""")
def band(data: Data):
    return data.events.select("event_id", clean.band("value", [5, 15], ["cold", "mild", "warm"]).alias("band"))


# -- filters ---------------------------------------------------------------------------


@query("f1_conditions", """
SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem
WHERE l_quantity > 30 AND l_returnflag = 'A'""")
def conditions(data: Data):
    return filters.where_all(data.lineitem, ["l_quantity > 30", "l_returnflag = 'A'"]).select(
        "l_orderkey", "l_linenumber", "l_quantity")


@query("f2_operators", """
SELECT o_orderkey FROM orders
WHERE o_orderstatus IN ('O', 'F') AND o_orderpriority = '1-URGENT' AND o_totalprice >= 50000
  AND o_totalprice <= 400000 AND o_orderpriority LIKE '1%'
  AND o_orderdate BETWEEN '1996-01-01' AND '1999-12-31'""")
def operators(data: Data):
    return filters.apply_specs(data.orders, [
        {"field": "o_orderstatus", "op": "in", "value": ["O", "F"]},
        {"field": "o_orderpriority", "value": "1-URGENT"},
        {"field": "o_orderstatus", "op": "in", "value": []},
        {"field": "o_totalprice", "op": "gte", "value": 50000},
        {"field": "o_totalprice", "op": "lte", "value": 400000},
        {"field": "o_orderpriority", "op": "like", "value": "1%"},
        {"field": "o_orderdate", "op": "between",
         "value": {"from": "1996-01-01", "to": "1999-12-31"}},
    ]).select("o_orderkey")


@query("f3_half_open_between", """
SELECT o_orderkey FROM orders WHERE o_totalprice >= 300000 AND o_orderdate <= '1998-06-30'""")
def half_open_between(data: Data):
    return filters.apply_specs(data.orders, [
        {"field": "o_totalprice", "op": "between", "value": {"from": 300000}},
        {"field": "o_orderdate", "op": "between", "value": {"to": "1998-06-30"}},
    ]).select("o_orderkey")


@query("f4_date_expressions", """
SELECT count(*) AS past FROM orders
WHERE CAST(o_orderdate AS DATE) BETWEEN current_date - 20000 AND date_trunc('year', current_date)""")
def date_expressions(data: Data):
    dated = data.orders.withColumn("day", F.col("o_orderdate").cast("date"))
    return filters.apply_specs(dated, [
        {"field": "day", "op": "between",
         "value": {"from": "current_date - 20000", "to": "year_start"}},
        {"field": "day", "op": "between", "value": {"to": "current_date + 1"}},
    ]).agg(F.count(F.lit(1)).alias("past"))


@query("f5_dictionary", """
SELECT l_orderkey, l_linenumber FROM lineitem
WHERE l_returnflag IN ('A', 'R') AND l_linestatus = 'F' AND l_quantity >= 10 AND l_quantity <= 40
  AND l_discount > 0.02 AND l_tax < 0.07""")
def dictionary(data: Data):
    return filters.apply_dict(data.lineitem, {
        "l_returnflag": ["A", "R"], "l_linestatus": "F", "l_quantity": {"min": 10, "max": 40},
        "l_discount": {"gt": 0.02}, "l_tax": {"lt": 0.07}, "l_partkey": None, "l_suppkey": [],
    }).select("l_orderkey", "l_linenumber")


@query("f6_start_end", """
SELECT o_orderkey FROM orders WHERE o_orderdate >= '1997-03-01' AND o_orderdate <= '1997-05-31'""")
def start_end(data: Data):
    return filters.apply_dict(data.orders, {
        "o_orderdate": {"start": "1997-03-01", "end": "1997-05-31"}}).select("o_orderkey")


@query("f7_date_to_date_id", """
SELECT o_orderkey, CAST(strftime(o_orderdate, '%Y%m%d') AS INTEGER) AS date_id FROM orders
WHERE strftime(o_orderdate, '%Y%m%d') BETWEEN '19970301' AND '19970531'""")
def date_to_date_id(data: Data):
    keyed = data.orders.select("o_orderkey", clean.date_key("o_orderdate").alias("date_id"))
    return filters.apply_dict(keyed, {"date": {"start": "1997-03-01", "end": "1997/05/31"}})


PERIODS_SQL = """
periods AS (
  SELECT o_custkey, year(o_orderdate)::INTEGER AS y,
         CAST(strftime(min(o_orderdate), '%Y%m%d') AS INTEGER) AS period_start_date_id,
         CAST(strftime(max(o_orderdate), '%Y%m%d') AS INTEGER) AS period_end_date_id
  FROM orders GROUP BY 1, 2)"""


def _periods(data: Data):
    """Per customer and year the period from its first to its last order."""
    key = clean.date_key("o_orderdate")
    return data.orders.groupBy("o_custkey", F.year("o_orderdate").alias("y")).agg(
        F.min(key).alias("period_start_date_id"), F.max(key).alias("period_end_date_id"))


@query("f8_period_overlap", f"""
WITH {PERIODS_SQL}
SELECT * FROM periods WHERE period_start_date_id <= 19970630 AND period_end_date_id >= 19970401""")
def period_overlap(data: Data):
    return filters.apply_dict(_periods(data), {"date": {"start": "1997-04-01", "end": "1997-06-30"}})


@query("f8_period_overlap_half_open", f"""
WITH {PERIODS_SQL} SELECT * FROM periods WHERE period_end_date_id >= 20000401""")
def period_overlap_half_open(data: Data):
    return filters.apply_dict(_periods(data), {"date": {"start": "2000-04-01"}})


@query("f9_absent_columns", "SELECT s_suppkey FROM supplier WHERE s_acctbal >= 0")
def absent_columns(data: Data):
    return filters.apply_dict(data.supplier, {
        "c_mktsegment": "BUILDING", "s_acctbal": {"min": 0}}).select("s_suppkey")


@query("f12_predicate_text", """
SELECT p_partkey FROM part WHERE p_brand IN ('Brand#1', 'Brand#2') AND p_size >= 5 AND p_size < 40""")
def predicate_text(data: Data):
    text = filters.predicate_text({
        "p_brand": ["Brand#1", "Brand#2"], "p_size": {"min": 5, "lt": 40}, "p_type": None})
    return data.part.filter(text).select("p_partkey")


@query("f13_guards", """
SELECT c_custkey, c_acctbal FROM customer
WHERE c_acctbal > 0 AND NOT regexp_matches(upper(c_name), '.*[-]?0[0-3]?$')
  AND NOT regexp_matches(upper(c_mktsegment), '^MACH')""")
def guards(data: Data):
    return data.customer.filter(
        filters.real_number("c_acctbal") & filters.not_matching("c_name", [r".*[-]?0[0-3]?$"])
        & filters.not_matching("c_mktsegment", ["^MACH"])
    ).select("c_custkey", "c_acctbal")


@query("f15_sane_bars", f"""
WITH {BARS_SQL}
SELECT ticker, count(*) AS bars FROM bars
WHERE high >= low AND high >= open AND high >= close AND low <= open AND low <= close
  AND volume >= 0 GROUP BY 1""")
def sane_bars(data: Data):
    return daily_bars(data).filter(filters.sane_bar()).groupBy("ticker").agg(
        F.count(F.lit(1)).alias("bars"))
