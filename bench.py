"""Times the headline queries and prints one JSON line.

``BENCH_SF_DIR`` names the data folder, ``BENCH_CPUS`` the local cores. Every query runs to a
sink that reads all rows and keeps none; the better of two runs counts.
"""

from __future__ import annotations

import json
import os
import re
import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starwright.operators import indicators, joins
from starwright.operators.pivot import PivotSpec, pivot
from starwright.plans import requests as R
from starwright.session import build_session, scratch_path
from starwright.sources import csv_files
from starwright.workload.charts import CUSTOMER_PATH
from starwright.workload.registry import Data
from starwright.workload.star import daily_bars, star

MACD = {
    "ema_12": {"indicator": "ema", "period": 12, "source": "close"},
    "ema_26": {"indicator": "ema", "period": 26, "source": "close"},
    "macd": {"indicator": "macd_line"},
    "macd_signal": {"indicator": "macd_signal"},
    "macd_histogram": {"indicator": "macd_histogram"},
    "atr_14": {"indicator": "atr", "period": 14},
}


def by_day_nation(data: Data, filters: list[dict]) -> DataFrame:
    return R.flat_table(star(data), [
        ["day", "temporal.date"], ["nation", "geo.n_name"], ["total", "sales.o_totalprice", "sum"],
        ["customers", "sales.o_custkey", "count_distinct"]], filters,
        path=["fact_orders", "dim_customer", "dim_nation"])


QUERIES = {
    "fact_scan_sorted": lambda d: d.lineitem.orderBy("l_shipdate", "l_orderkey", "l_linenumber"),
    "fact_left_dim": lambda d: joins.enrich(
        d.orders, d.customer, ["o_custkey=c_custkey"], ["c_name", "c_mktsegment"]),
    "fact_left_dim_dim": lambda d: joins.enrich(
        joins.enrich(d.orders, d.customer, ["o_custkey=c_custkey"], ["c_name", "c_nationkey"]),
        d.nation, ["c_nationkey=n_nationkey"], ["n_name"]),
    "aggregate_day_part": lambda d: d.lineitem.groupBy(
        F.col("l_shipdate").cast("date").alias("day"), "l_partkey").agg(
        F.avg("l_extendedprice").alias("mean"), F.sum("l_quantity").alias("volume")),
    "aggregate_day_nation": lambda d: by_day_nation(d, []),
    "aggregate_day_nation_filtered": lambda d: by_day_nation(d, [
        {"field": "temporal.date", "op": "between", "value": {"from": "1997-03-03", "to": "1997-03-09"}},
        {"field": "geo.n_name", "op": "in", "value": ["NATION_1", "NATION_2", "NATION_3"]}]),
    "pivot_region_year_totals": lambda d: R.pivot_request(
        star(d), ["geo.r_name", "geo.n_name"], [["sales", "sales.l_extendedprice", "sum"]],
        cols=["temporal.year"], path=CUSTOMER_PATH, row_totals=True),
    "all_indicators": lambda d: indicators.add_indicators(
        indicators.add_technicals(daily_bars(d), "ticker", "trade_date"), MACD, "ticker", "trade_date"),
    "chart_region_month": lambda d: R.chart(
        star(d), "temporal.year_month", "sales.l_extendedprice", "geo.r_name", "sum", path=CUSTOMER_PATH),
    "pivot_flag_status": lambda d: pivot(d.lineitem, PivotSpec(
        rows={"day": "to_date(l_shipdate)"}, cols={"flag": "l_returnflag", "status": "l_linestatus"},
        measures=[["qty", "l_quantity", "sum"], ["n", "*", "count"]])),
}


RAW_FIELDS = [
    {"name": "l_orderkey", "type": "long", "source": "order_key"},
    {"name": "l_partkey", "type": "long", "source": "part_key"},
    {"name": "quantity", "type": "double"}, {"name": "price", "type": "double"},
    {"name": "flag", "type": "string"}, {"name": "ship_date", "type": "date"},
]


def raw_lines(data: Data) -> str:
    """The line items as a CSV download, for the ingest measurement."""
    path = scratch_path(data.spark, "raw")
    data.lineitem.select(
        F.col("l_orderkey").alias("Order Key"), F.col("l_partkey").alias("Part Key"),
        F.col("l_quantity").alias("Quantity"), F.col("l_extendedprice").alias("Price"),
        F.col("l_returnflag").alias("Flag"), F.date_format("l_shipdate", "M/d/yyyy").alias("Ship Date"),
    ).repartition(int(data.spark.conf.get("spark.sql.shuffle.partitions"))).write.csv(path, header=True)
    return path


def run(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", {
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    data = Data(spark, folder)
    run(data.lineitem.groupBy("l_returnflag").count())  # starts the JVM's threads
    raw = raw_lines(data)
    queries = {**QUERIES, "ingest_csv": lambda d: csv_files.read_csv(
        spark, raw, RAW_FIELDS, year_from="ship_date", quoted_newlines=False)}
    times = {}
    for name, build in queries.items():
        runs = []
        for _ in range(2):
            start = time.perf_counter()
            run(build(data))
            runs.append(time.perf_counter() - start)
        times[name] = round(min(runs), 3)
    scale = re.search(r"sf([\d.]+)", folder)
    print(json.dumps({
        "metric": "headline queries, total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": float(scale.group(1)) if scale else None,
        "ingest_records_per_sec": round(data.lineitem.count() / times["ingest_csv"])}))
    spark.stop()


if __name__ == "__main__":
    main()
