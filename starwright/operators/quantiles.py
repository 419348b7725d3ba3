"""Exact percentiles without gathering a group in one task.

Spark's exact ``percentile`` keeps every distinct value of a group in one buffer. Here a
mergeable sketch brackets the wanted ranks first, then everything outside the brackets is
reduced to counts on the map side; only the values in the brackets are ranked.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starwright.operators.ordered import GlobalOrder

BROADCAST_GROUPS = 50_000  # one row of bracket ends per group: some megabytes


def exact_percentiles(
    df: DataFrame, by: Sequence[str], value: str, probs: Sequence[float],
    names: Sequence[str] | None = None, accuracy: int = 2_000,
) -> DataFrame:
    """Continuous percentiles per group (one row overall when ``by`` is empty).

    Reads the input twice, however many percentiles are asked for. Without groups the brackets are
    literals; those of at most BROADCAST_GROUPS groups are broadcast, so raw rows are not
    shuffled by their group. With more groups, rows are counted by (group, value) before they
    meet the brackets. The values in brackets, about ``4/accuracy`` of the distinct ones
    per percentile, are ranked over range partitions. NULL values are left out.
    """
    names = list(names or [f"p{round(p * 100):g}" for p in probs])
    keys = [f"__k{i}" for i in range(len(by))] or ["__k0"]
    src = df.select(
        *([F.col(c).alias(k) for c, k in zip(by, keys)] or [F.lit(0).alias("__k0")]),
        F.col(value).cast("double").alias("__v"),
    ).filter(F.col("__v").isNotNull())
    slack = 2.0 / accuracy
    ends = [q for p in probs for q in (max(p - slack, 0.0), min(p + slack, 1.0))]
    sketch = src.groupBy(*keys).agg(
        F.percentile_approx("__v", ends, accuracy).alias("__q"),
        F.count(F.lit(1)).alias("__n"),
    )
    bracketed = _with_brackets(src, sketch, keys) if by else _with_bracket(src, sketch, len(ends))
    q, v = F.col("__q"), F.col("__v")
    pairs = [(q[2 * i], q[2 * i + 1]) for i in range(len(probs))]
    inside = reduce(lambda a, b: a | b, [v.between(low, high) for low, high in pairs])
    # what lies between two brackets is one row: its number of brackets below
    below = reduce(lambda a, b: a + b, [F.when(v > high, 1).otherwise(0) for _, high in pairs])
    counted = bracketed.groupBy(
        *keys, "__n", "__before", F.when(inside, v).alias("__in"), F.when(~inside, below).alias("__lump"),
    ).agg(F.sum("__c").alias("__c"), F.min("__v").alias("__min"), F.max("__v").alias("__max"))
    order = GlobalOrder(counted, [*keys, "__min"]).running_sum("__run", "__c")
    placed = order.rows.withColumn("__top", F.col("__run") - F.col("__before"))
    ranks = [F.lit(p) * (F.col("__n") - 1) for p in probs]
    found = placed.groupBy(*keys).agg(*[
        column for i, rank in enumerate(ranks) for column in (
            F.max(_held(F.floor(rank))).alias(f"__l{i}"),
            F.max(_held(F.least(F.floor(rank) + 1, F.col("__n") - 1))).alias(f"__u{i}"),
            F.max(rank - F.floor(rank)).alias(f"__f{i}"))])
    return found.select(
        *[F.col(k).alias(c) for c, k in zip(by, keys)],
        *[(F.col(f"__l{i}") + (F.col(f"__u{i}") - F.col(f"__l{i}")) * F.col(f"__f{i}")).alias(n)
          for i, n in enumerate(names)])


def _with_bracket(src: DataFrame, sketch: DataFrame, ends: int) -> DataFrame:
    """The one bracket of a whole table as literals."""
    row = sketch.select("__q", "__n").first()
    bounds, n = (row["__q"], row["__n"]) if row else ([0.0] * ends, 0)
    return src.select("*", F.lit(1).alias("__c"), F.lit(n).cast("long").alias("__n"),
                      F.lit(0).cast("long").alias("__before"),
                      F.array(*[F.lit(float(b)) for b in bounds]).alias("__q"))


def _with_brackets(src: DataFrame, sketch: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows with the brackets of their group, and the rows of all groups before it."""
    groups = GlobalOrder(sketch, keys).running_sum("__upto", "__n").result()
    groups = groups.withColumn("__before", F.col("__upto") - F.col("__n")).drop("__upto")
    if groups.count() <= BROADCAST_GROUPS:
        rows, groups = src.withColumn("__c", F.lit(1)), F.broadcast(groups)
    else:
        rows = src.groupBy(*keys, "__v").agg(F.count(F.lit(1)).alias("__c"))
    same = reduce(lambda a, b: a & b, [F.col(f"s.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys])
    return rows.alias("s").join(groups.alias("b"), same).select(
        *[F.col(f"s.{k}").alias(k) for k in keys], "__v", "__c", "__n", "__before", "__q")


def _held(k: Column) -> Column:
    """Value at 0-based rank k if this row holds it; of a lump only the ends are known."""
    top, first = F.col("__top"), F.col("__top") - F.col("__c")
    return (
        F.when((k < first) | (k >= top), None)
        .when(F.col("__lump").isNull() | (k == first), F.col("__min"))
        .when(k == top - 1, F.col("__max"))
        .otherwise(F.raise_error(F.lit("percentile outside its bracket")).cast("double"))
    )
