"""Helpers that several operators share: staging, checked broadcasts, numbering, components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from starwright.session import BATCH_BYTES, BATCH_SETTING, scratch_path

BROADCAST_ROWS = 500_000  # of a few fixed-width columns: some 16 MB
BUCKET_ROWS = 200_000  # rows that one task may number


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends, executors may be lost."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession) -> None:
    """From now on rows go to Python workers in batches of about BATCH_BYTES, unless the session names a size.

    Spark's own bound is 64 MB; a batch of whole texts then takes several times that of an executor, in buffers
    outside the heap that double as they fill and in the worker. What a batch holds does not change any result.
    """
    if spark.conf.get(BATCH_SETTING, None) is None:
        spark.conf.set(BATCH_SETTING, BATCH_BYTES)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast a staged table of narrow rows if it has at most ``rows``; else leave it to Spark.

    The table is counted first, so the broadcast is of a known size; a larger one is joined by
    shuffle.
    """
    return F.broadcast(df) if df.count() <= rows else df


def running_total(
    df: DataFrame, by: list[str], order: list[str], value: Column, name: str, buckets: int,
) -> DataFrame:
    """Add the sum of ``value`` over the rows before each row of its ``by`` group.

    The order is a fixed one: by bucket (a hash of ``order``), then by ``order``. Groups of any
    size are summed in pieces: a window inside each (group, bucket), plus the total of the
    buckets before, of which there is one row per group and bucket.
    """
    keyed = df.withColumn("__b", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    sums = keyed.groupBy(*by, "__b").agg(F.sum(value).alias("__s"))
    before = Window.partitionBy(*by).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(
        *[F.col(c).alias(f"__k{i}") for i, c in enumerate(by)], F.col("__b").alias("__kb"),
        F.coalesce(F.sum("__s").over(before), F.lit(0)).alias("__o"))
    inside = Window.partitionBy(*by, "__b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    same = F.col("__b") == F.col("__kb")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"__k{i}"))
    return (
        keyed.withColumn("__in", F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .join(sums, same)
        .withColumn(name, F.col("__in") + F.col("__o"))
        .drop("__b", "__in", "__o", "__kb", *[f"__k{i}" for i in range(len(by))])
    )


def buckets_for(rows: int) -> int:
    return max(1, -(-rows // BUCKET_ROWS))


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """``(id, component)`` of every end of ``edges (a, b)``; component is the smallest id reachable.

    Each round hooks every component to its smallest neighbour, follows the hooks to their
    ends, and rewrites the edges in terms of components; edges inside one vanish. Rounds grow
    with the logarithm of the longest chain. Only staged tables pass between rounds.
    """
    pairs = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    pairs = stage(pairs.where("a <> b").distinct(), label)
    ends = edges.select(F.col("a").alias("id")).union(edges.select(F.col("b").alias("id"))).distinct()
    labels = stage(ends.withColumn("component", F.col("id")), label)
    while not pairs.isEmpty():
        # a component that is someone's larger end hooks to its smallest smaller neighbour
        hooks = stage(pairs.groupBy(F.col("b").alias("c")).agg(F.min("a").alias("to")), label)
        while True:
            up = hooks.select(F.col("c").alias("to"), F.col("to").alias("top"))
            jumped = stage(
                hooks.join(up, "to", "left").select("c", F.coalesce("top", "to").alias("to"),
                                                    F.col("top").isNotNull().alias("moved")), label)
            hooks = jumped.select("c", "to")
            if jumped.where("moved").isEmpty():
                break
        new = hooks.select(F.col("c").alias("component"), F.col("to").alias("root"))
        labels = stage(
            labels.join(new, "component", "left")
            .select("id", F.coalesce("root", "component").alias("component")), label)
        a = hooks.select(F.col("c").alias("a"), F.col("to").alias("ra"))
        b = hooks.select(F.col("c").alias("b"), F.col("to").alias("rb"))
        moved = pairs.join(a, "a", "left").join(b, "b", "left").select(
            F.coalesce("ra", "a").alias("x"), F.coalesce("rb", "b").alias("y"))
        pairs = stage(
            moved.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
            .distinct(), label)
    return labels
