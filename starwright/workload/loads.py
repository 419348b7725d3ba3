"""Table writes and stream loads: each writes to a fresh path and returns what is stored."""

from __future__ import annotations

from pyspark.sql import functions as F

from starwright.session import scratch_path
from starwright.sinks import tables as sink
from starwright.sources.tables import scan
from starwright.streaming import loads
from starwright.workload.registry import Data, query
from starwright.workload.star import dated_orders, day_dimension


def target(data: Data, label: str) -> str:
    return scratch_path(data.spark, label)


@query("k1_write_partitioned", """
SELECT o_orderkey, o_orderstatus, year(o_orderdate)::INTEGER AS year FROM orders""")
def write_partitioned(data: Data):
    path = target(data, "k1")
    dated = data.orders.select("o_orderkey", "o_orderstatus", F.year("o_orderdate").alias("year"))
    sink.write(dated.filter("o_orderstatus = 'F'"), path, "overwrite", ["year", "absent"])
    sink.write(dated.filter("o_orderstatus <> 'F'"), path, "append", ["year"])
    return scan(data.spark, path)


@query("k2_write_if_missing", "SELECT s_suppkey, s_name FROM supplier")
def write_if_missing(data: Data):
    path = target(data, "k2")
    first = data.supplier.select("s_suppkey", "s_name")
    sink.write_if_missing(first, path)
    sink.write_if_missing(first.withColumn("s_name", F.lit("late")), path)
    return scan(data.spark, path)


@query("k3_append_immutable", """
SELECT o_orderkey, CASE WHEN o_orderdate < '1998-07-01' THEN 'first' ELSE 'second' END AS batch,
       o_orderdate::DATE AS day, year(o_orderdate)::INTEGER AS year FROM orders""")
def append_immutable(data: Data):
    """Two overlapping batches with copies; the rows stored first stay."""
    path = target(data, "k3")
    dated = data.orders.select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"),
                               F.year("o_orderdate").alias("year"))
    for name, cond in (("first", "day < '1998-07-01'"), ("second", "day >= '1998-01-01'")):
        batch = dated.filter(cond).withColumn("batch", F.lit(name))
        sink.append_immutable(batch.unionByName(batch), path, ["o_orderkey"], ["year"], "day",
                              year_column="year")
    return scan(data.spark, path)


UPSERT_SQL = """
SELECT c_custkey, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN {new} ELSE {old} END AS balance
FROM customer"""


@query("k4_upsert", UPSERT_SQL.format(new="c_acctbal + 1000", old="c_acctbal"))
def upsert(data: Data):
    path = target(data, "k4")
    base = data.customer.select("c_custkey", F.col("c_acctbal").alias("balance"))
    new = data.customer.filter("c_mktsegment IN ('BUILDING', 'MACHINERY')").select(
        "c_custkey", (F.col("c_acctbal") + 1000).alias("balance"))
    sink.upsert(base.unionByName(base), path, ["C_CUSTKEY"])
    sink.upsert(new, path, ["c_custkey"])
    return scan(data.spark, path)


@query("k4_upsert_keep_existing", """
SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN c_acctbal ELSE -1 END AS balance FROM customer""")
def upsert_keep_existing(data: Data):
    path = target(data, "k4b")
    sink.upsert(data.customer.filter("c_mktsegment = 'BUILDING'").select(
        "c_custkey", F.col("c_acctbal").alias("balance")), path, ["c_custkey"])
    sink.upsert(data.customer.select("c_custkey", F.lit(-1.0).alias("balance")), path,
                ["c_custkey"], update_existing=False)
    return scan(data.spark, path)


@query("k4_upsert_partitions", """
SELECT o_orderkey, year(o_orderdate)::INTEGER AS year,
       CASE WHEN year(o_orderdate) = 1997 THEN 'X' ELSE o_orderstatus END AS status FROM orders""")
def upsert_partitions(data: Data):
    """With the partition column in the key only the touched partitions are rewritten."""
    path = target(data, "k4c")
    base = data.orders.select("o_orderkey", F.col("o_orderstatus").alias("status"),
                              F.year("o_orderdate").alias("year"))
    sink.upsert(base, path, ["year", "o_orderkey"], ["year"])
    sink.upsert(base.filter("year = 1997").withColumn("status", F.lit("X")), path,
                ["year", "o_orderkey"], ["year"])
    return scan(data.spark, path).select("o_orderkey", "year", "status")


@query("k4_null_partition", """
SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN year(o_orderdate) END::INTEGER AS year,
       CASE WHEN o_orderstatus = 'P' AND o_orderkey % 2 = 0 OR year(o_orderdate) = 1997 AND o_orderstatus <> 'P'
            THEN 'X' ELSE o_orderstatus END AS status FROM orders""")
def upsert_null_partition(data: Data):
    """Rows without a partition value are rewritten with their partition, and none is lost."""
    path = target(data, "k4n")
    base = data.orders.select("o_orderkey", F.col("o_orderstatus").alias("status"), F.when(
        F.col("o_orderstatus") != "P", F.year("o_orderdate")).alias("year"))
    sink.upsert(base, path, ["year", "o_orderkey"], ["year"])
    new = base.filter("year IS NULL AND o_orderkey % 2 = 0 OR year = 1997").withColumn("status", F.lit("X"))
    sink.upsert(new, path, ["year", "o_orderkey"], ["year"])
    return scan(data.spark, path).select("o_orderkey", "year", "status")


@query("k4_stored_duplicates", """
SELECT c_custkey, c_acctbal + CASE WHEN c_mktsegment = 'BUILDING' THEN 1000 ELSE 0 END AS balance FROM customer""")
def upsert_stored_duplicates(data: Data):
    """A table that already holds every key twice has each once afterwards."""
    path = target(data, "k4d")
    base = data.customer.select("c_custkey", F.col("c_acctbal").alias("balance"))
    sink.write(base.unionByName(base), path)
    sink.upsert(data.customer.filter("c_mktsegment = 'BUILDING'").select(
        "c_custkey", (F.col("c_acctbal") + 1000).alias("balance")), path, ["c_custkey"])
    return scan(data.spark, path)


@query("k4_late_rows", """
SELECT user_id, arg_max(event_type, (ts, event_id)) AS last_type, max(ts)::DATE AS day FROM events GROUP BY 1""")
def upsert_late_rows(data: Data):
    """A second batch with older versions of all rows changes nothing."""
    path = target(data, "k4e")
    batch = data.events.select("user_id", "ts", "event_id", F.col("event_type").alias("last_type"))
    late = batch.withColumns({"ts": F.col("ts") - F.expr("INTERVAL 400 DAYS"), "last_type": F.lit("late")})
    for rows in (batch, late):
        sink.upsert(rows, path, ["user_id"], order=["ts", "event_id"])
    return scan(data.spark, path).select("user_id", "last_type", F.col("ts").cast("date").alias("day"))


@query("k3_null_dates", """
SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_orderdate::DATE END AS day FROM orders""")
def append_null_dates(data: Data):
    """Rows without a date are stored, and stored once."""
    path = target(data, "k3n")
    batch = data.orders.select("o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate").cast("date")).alias("day"))
    for rows in (batch.filter("day IS NOT NULL"), batch.filter("day IS NULL"), batch):
        sink.append_immutable(rows, path, ["o_orderkey", "day"], date_column="day")
    return scan(data.spark, path)


@query("k3_null_keys", "SELECT DISTINCT nullif(o_orderstatus, 'P') AS status FROM orders")
def append_null_keys(data: Data):
    path = target(data, "k3k")
    batch = data.orders.select(F.nullif("o_orderstatus", F.lit("P")).alias("status"))
    for _ in range(2):
        sink.append_immutable(batch, path, ["status"])
    return scan(data.spark, path)


@query("k3_key_moves_date", "SELECT o_orderkey, o_orderdate::DATE AS day FROM orders")
def append_key_moves_date(data: Data):
    """A key that comes again under a far date is not stored twice."""
    path = target(data, "k3m")
    batch = data.orders.select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"))
    for rows in (batch, batch.withColumn("day", F.date_add("day", 10_000))):
        sink.append_immutable(rows, path, ["o_orderkey"], date_column="day")
    return scan(data.spark, path)


@query("k5_nan_to_null", """
SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN NULL ELSE c_nationkey END AS nation FROM customer""")
def nan_to_null(data: Data):
    path = target(data, "k5")
    sink.upsert(data.customer.select("c_custkey", F.col("c_nationkey").alias("nation")), path, ["c_custkey"])
    nan = data.customer.filter("c_mktsegment = 'BUILDING'").select(
        "c_custkey", F.lit(float("nan")).alias("nation"))
    sink.upsert(nan, path, ["c_custkey"])
    return scan(data.spark, path)


@query("k6_resolved_keys", "SELECT o_custkey, max(o_orderkey) AS last FROM orders GROUP BY 1")
def resolved_keys(data: Data):
    keys = sink.resolve_keys(data.orders, ["O_CUSTKEY"])
    return data.orders.groupBy(*keys).agg(F.max("o_orderkey").alias("last"))


@query("k7_strategy", """
SELECT event_id, ts::DATE AS day, 'second' AS load FROM events""")
def strategy(data: Data):
    """Two appends keep the first rows, the upsert then replaces them all."""
    path = target(data, "k7")
    batch = data.events.select("event_id", F.col("ts").cast("date").alias("day"), F.lit("first").alias("load"))
    for _ in range(2):
        sink.smart_write(batch, path, "append", ["event_id"], ["day"], "day")
    sink.smart_write(batch.withColumn("load", F.lit("second")), path, "upsert", ["event_id", "day"], ["day"])
    return scan(data.spark, path).select("event_id", "day", "load")


@query("k8_evolving_schema", """
SELECT c_custkey AS id, c_acctbal AS balance, CAST(NULL AS VARCHAR) AS label FROM customer
UNION ALL SELECT s_suppkey, s_acctbal, s_name FROM supplier""")
def evolving_schema(data: Data):
    path = target(data, "k8")
    sink.write_evolving(data.customer.select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance")), path)
    sink.write_evolving(data.supplier.select(
        F.col("s_suppkey").cast("string").alias("id"), F.col("s_acctbal").cast("float").cast("double").alias("balance"),
        F.col("s_name").alias("label")).withColumn("balance", F.round("balance", 2)), path)
    return scan(data.spark, path, merge_schema=True)


@query("k9_merge", """
SELECT p_partkey, CASE WHEN p_size < 10 THEN p_retailprice * 2 ELSE p_retailprice END AS price,
       CASE WHEN p_size < 10 THEN 'updated' ELSE 'old' END AS state FROM part WHERE p_size < 40
UNION ALL SELECT p_partkey, p_retailprice, 'inserted' FROM part WHERE p_size >= 40""")
def merge(data: Data):
    path = target(data, "k9")
    sink.write(data.part.filter("p_size < 40").select(
        "p_partkey", F.col("p_retailprice").alias("price"), F.lit("old").alias("state")), path)
    source = data.part.filter("p_size < 10 OR p_size >= 40").select(
        "p_partkey", F.col("p_retailprice").alias("price"))
    sink.merge(source, path, ["p_partkey"], update={"price": "t.price * 2", "state": "'updated'"},
               insert={"p_partkey": "s.p_partkey", "price": "s.price", "state": "'inserted'"})
    return scan(data.spark, path)


NULL_KEY_MERGE_SQL = """
SELECT nullif(s_nationkey, 3) AS nation, count(*) + CASE WHEN {again} THEN 1000 ELSE 0 END AS n
FROM supplier GROUP BY 1"""


@query("k9_null_keys", NULL_KEY_MERGE_SQL.format(again="nullif(s_nationkey, 3) IS NULL OR nullif(s_nationkey, 3) > 10"))
def merge_null_keys(data: Data):
    """A NULL key is updated like the others, and inserted once only."""
    path = target(data, "k9n")
    counts = data.supplier.groupBy(F.nullif("s_nationkey", F.lit(3)).alias("nation")).agg(F.count(F.lit(1)).alias("n"))
    sink.write(counts.filter("nation <= 10"), path)
    for add in (0, 1000):
        sink.merge(counts.filter("nation IS NULL OR nation > 10").withColumn("n", F.col("n") + add), path, ["nation"])
    return scan(data.spark, path)


@query("k10_null_keys", """
SELECT p_partkey, nullif(p_size, 7) AS size FROM part WHERE p_size NOT IN (7, 8)""")
def merge_delete_null_keys(data: Data):
    path = target(data, "k10n")
    rows = data.part.select("p_partkey", F.nullif("p_size", F.lit(7)).alias("size"))
    sink.write(rows, path)
    sink.merge_delete(rows.filter("size IS NULL OR size = 8"), path, ["size"])
    return scan(data.spark, path)


@query("k10_merge_delete", "SELECT p_partkey, p_brand FROM part WHERE p_size >= 10")
def merge_delete(data: Data):
    path = target(data, "k10")
    sink.write(data.part.select("p_partkey", "p_brand"), path)
    sink.merge_delete(data.part.filter("p_size < 10"), path, ["p_partkey"])
    return scan(data.spark, path)


@query("k11_cluster", "SELECT l_orderkey, l_partkey, l_quantity FROM lineitem")
def cluster(data: Data):
    path = target(data, "k11")
    sink.write(data.lineitem.select("l_orderkey", "l_partkey", "l_quantity"), path)
    sink.cluster(data.spark, path, ["l_partkey"], files=4)
    return scan(data.spark, path)


@query("k11_zorder", "SELECT l_orderkey, l_partkey, l_shipdate::DATE AS day, l_quantity FROM lineitem")
def cluster_zorder(data: Data):
    """Clustered by two columns at once; the rows stay what they are."""
    path = target(data, "k11z")
    sink.write(data.lineitem.select("l_orderkey", "l_partkey", F.col("l_shipdate").cast("date").alias("day"),
                                    "l_quantity"), path)
    sink.cluster(data.spark, path, ["l_partkey", "day"], files=16, zorder=True)
    return scan(data.spark, path)


@query("k12_spread_for_write", """
SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY 1""")
def spread_for_write(data: Data):
    path = target(data, "k12")
    sink.write(data.lineitem.select("l_orderkey", "l_returnflag"), path, partitions=["l_returnflag"])
    return scan(data.spark, path).groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))


@query("k13_present_partitions", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def present_partitions(data: Data):
    keys = sink.present_partitions(data.orders, ["o_orderstatus", "year"])
    return data.orders.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


@query("k14_star_layout", """
SELECT year(o_orderdate)::INTEGER AS year, c_mktsegment, count(*) AS n FROM orders
JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2""")
def star_layout(data: Data):
    paths = sink.write_star({
        "fact_orders": dated_orders(data).select("o_orderkey", "o_custkey", "date_id", "o_orderstatus"),
        "dim_customer": data.customer, "dim_calendar": day_dimension(data).select("date_id", "year"),
    }, target(data, "k14"), {"fact_orders": ["o_orderstatus"]})
    read = {n: scan(data.spark, p) for n, p in paths.items()}
    return (read["fact_orders"].join(read["dim_calendar"], "date_id")
            .join(read["dim_customer"], F.col("o_custkey") == F.col("c_custkey"))
            .groupBy("year", "c_mktsegment").agg(F.count(F.lit(1)).alias("n")))


@query("k15_delete_where", """
SELECT o_orderkey, nullif(o_orderstatus, 'P') AS status FROM orders
WHERE o_orderstatus IS NULL OR o_orderstatus <> 'F'""")
def delete_where(data: Data):
    path = target(data, "k15")
    sink.write(data.orders.select("o_orderkey", F.nullif("o_orderstatus", F.lit("P")).alias("status")), path)
    counted = sink.delete_where(data.spark, path, "status = 'F'", dry_run=True)
    deleted = sink.delete_where(data.spark, path, "status = 'F'")
    assert counted == deleted
    return scan(data.spark, path)


# -- streams ---------------------------------------------------------------------------


def event_stream(data: Data):
    schema = data.events.schema
    return loads.file_stream(data.spark, data.folder, schema, pathGlobFilter="events.parquet",
                             recursiveFileLookup="false")


def run(writer) -> None:
    started = writer.start()
    started.awaitTermination()


@query("t1_append_stream", "SELECT event_id, ts::DATE AS day, value FROM events")
def append_stream(data: Data):
    """The same events streamed twice are stored once."""
    path = target(data, "t1")
    stream = event_stream(data).select("event_id", F.col("ts").cast("date").alias("day"), "value")
    for _ in range(2):
        run(loads.append_stream(stream, path, ["event_id"], target(data, "t1-state"), ["day"], "day"))
    return scan(data.spark, path)


@query("t2_upsert_stream", """
SELECT user_id, arg_max(event_type, (ts, event_id)) AS last_type, max(ts)::DATE AS day FROM events GROUP BY 1""")
def upsert_stream(data: Data):
    path = target(data, "t2")
    stream = event_stream(data).select("user_id", "ts", "event_id", F.col("event_type").alias("last_type"))
    run(loads.upsert_stream(stream, path, ["user_id"], target(data, "t2-state"), order=["ts", "event_id"]))
    return scan(data.spark, path).select("user_id", "last_type", F.col("ts").cast("date").alias("day"))


@query("t3_refill_stream", """
SELECT (event_id % 3)::INTEGER AS load_batch, count(*) AS rows FROM events GROUP BY 1""")
def refill_stream(data: Data):
    """Files land three times; each time the stream takes up where it stopped, with one more batch."""
    landing, path, state = (target(data, n) for n in ("t3-landing", "t3", "t3-state"))
    for part in range(3):
        data.events.filter(F.col("event_id") % 3 == part).write.mode("append").parquet(landing)
        run(loads.refill_stream(loads.file_stream(data.spark, landing, data.events.schema), path, state))
    return loads.loaded_rows(data.spark, path)


@query("t4_dedup_stream", """
SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2""")
def dedup_stream(data: Data):
    """Every event arrives twice; the copy is dropped by event id within the watermark."""
    path = target(data, "t4")
    stream = event_stream(data).withColumn("ts", F.col("ts").cast("timestamp"))
    doubled = stream.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    once = loads.dedup_stream(doubled, ["event_id"], "ts", "40 days").drop("copy")
    writer = (once.writeStream.format("parquet").option("path", path)
              .option("checkpointLocation", target(data, "t4-state")).trigger(availableNow=True))
    run(writer)
    return scan(data.spark, path).groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
