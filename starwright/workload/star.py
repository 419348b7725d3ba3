"""The star the registered queries run on."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starwright.functions import clean
from starwright.operators.joins import edge
from starwright.plans.catalog import Catalog
from starwright.sources.tables import calendar
from starwright.workload.registry import Data

# The date range of the calendar dimension, wide enough for any order.
CALENDAR_RANGE = ("1970-01-01", "2069-12-31")


def day_dimension(data: Data) -> DataFrame:
    """The calendar: the usual range, widened to whole years that hold every dated fact."""
    low, high = data.orders.agg(F.min("o_orderdate"), F.max("o_orderdate")).first()
    first, last = CALENDAR_RANGE
    if low is not None:
        first, last = min(first, f"{low.year:04d}-01-01"), max(last, f"{high.year:04d}-12-31")
    return calendar(data.spark, first, last)


def dated_orders(data: Data) -> DataFrame:
    return data.orders.withColumn("date_id", clean.date_key("o_orderdate"))


@lru_cache(maxsize=16)
def star(data: Data) -> Catalog:
    """Facts lineitem and orders with their dimensions and a calendar; made once per folder."""
    catalog = Catalog()
    catalog.add("sales", "fact_lineitem", data.lineitem)
    catalog.add("sales", "fact_orders", dated_orders(data))
    catalog.add("parties", "dim_customer", data.customer)
    catalog.add("parties", "dim_supplier", data.supplier)
    catalog.add("goods", "dim_part", data.part)
    catalog.add("geo", "dim_nation", data.nation)
    catalog.add("geo", "dim_region", data.region)
    catalog.add("temporal", "dim_calendar", day_dimension(data))
    catalog.depends_on.update({
        "sales": ["parties", "goods", "temporal"], "parties": ["geo"],
    })
    return catalog.link(
        edge("fact_lineitem", "fact_orders", "l_orderkey=o_orderkey"),
        edge("fact_orders", "dim_customer", "o_custkey=c_custkey"),
        edge("dim_customer", "dim_nation", "c_nationkey=n_nationkey"),
        edge("dim_nation", "dim_region", "n_regionkey=r_regionkey"),
        edge("fact_lineitem", "dim_part", "l_partkey=p_partkey"),
        edge("fact_lineitem", "dim_supplier", "l_suppkey=s_suppkey"),
        edge("dim_supplier", "dim_nation", "s_nationkey=n_nationkey"),
        edge("fact_orders", "dim_calendar", "date_id=date_id"),
    )


def daily_bars(data: Data) -> DataFrame:
    """Price series per return flag and ship day, from unit prices of line items.

    Open and close are the prices of the smallest and largest row of the day in a full row
    order, so the series does not depend on how rows are read.
    """
    row = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
                   "l_extendedprice", "l_discount", "l_tax", "l_linestatus")
    price = F.col("l_extendedprice") / F.col("l_quantity")
    return data.lineitem.groupBy(
        F.col("l_returnflag").alias("ticker"), F.col("l_shipdate").cast("date").alias("trade_date"),
    ).agg(
        F.min_by(price, row).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"),
        F.max_by(price, row).alias("close"), F.sum("l_quantity").alias("volume"),
    )


# The same series in SQL, to be put before a query as ``WITH`` members.
BARS_SQL = """
ranked AS (
  SELECT l_returnflag AS ticker, CAST(l_shipdate AS DATE) AS trade_date,
         l_extendedprice / l_quantity AS price, l_quantity,
         row_number() OVER (PARTITION BY l_returnflag, CAST(l_shipdate AS DATE)
           ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity,
                    l_extendedprice, l_discount, l_tax, l_linestatus) AS first_no,
         row_number() OVER (PARTITION BY l_returnflag, CAST(l_shipdate AS DATE)
           ORDER BY l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC,
                    l_quantity DESC, l_extendedprice DESC, l_discount DESC, l_tax DESC,
                    l_linestatus DESC) AS last_no
  FROM lineitem),
bars AS (
  SELECT ticker, trade_date, max(price) FILTER (WHERE first_no = 1) AS open,
         max(price) AS high, min(price) AS low,
         max(price) FILTER (WHERE last_no = 1) AS close, sum(l_quantity) AS volume
  FROM ranked GROUP BY 1, 2)
"""
