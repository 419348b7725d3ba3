"""Window calculations over orders that are too long for one task.

A Spark window sorts each of its partitions in one task. Two cases need more than that:
a calculation along the order of the *whole* table (no partition key), and a series whose
entity may hold a large part of all rows. Both are split here, with exact results.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from starwright.session import durable

ROW_BITS = 33  # monotonically_increasing_id keeps the row number in the lower 33 bits


class GlobalOrder:
    """Rows in one global order, spread over range partitions.

    Each calculation runs inside the partitions, and what it carries over from the
    partitions before comes from one summary row per partition. The ranged rows are
    written to the shared folder once, since the partition bounds must not move between
    the two steps.
    """

    def __init__(self, df: DataFrame, order: Sequence[Column | str]):
        # no partition count given: AQE merges small neighbouring ranges
        self.rows = durable(
            df.repartitionByRange(*order).sortWithinPartitions(*order)
            .withColumn("__id", F.monotonically_increasing_id())
        ).withColumn("__part", F.shiftright("__id", ROW_BITS))
        self._in_part = Window.partitionBy("__part").orderBy("__id")
        self._parts = Window.orderBy("__part")  # over one row per partition only

    def add(self, columns: Mapping[str, tuple[str, Column | str]]) -> GlobalOrder:
        """Add columns ``{name: (kind, value)}`` in one pass.

        Kinds: ``lag`` (value of the row before), ``sum`` and ``max`` (running, up to the
        row itself).
        """
        upto = self._in_part.rowsBetween(Window.unboundedPreceding, 0)
        before = self._parts.rowsBetween(Window.unboundedPreceding, -1)
        summary, carried, inside, combined = [], [], [], {}
        for i, (name, (kind, value)) in enumerate(columns.items()):
            v = F.col(value) if isinstance(value, str) else value
            s, x, c = f"__s{i}", f"__x{i}", f"__c{i}"
            if kind == "lag":
                boxed = F.struct(v.alias("v"))  # a NULL value is not a missing row
                summary.append(F.max_by(boxed, F.col("__id")).alias(s))
                carried.append(F.lag(s).over(self._parts).alias(c))
                inside.append(F.lag(boxed).over(self._in_part).alias(x))
                combined[name] = F.coalesce(F.col(x), F.col(c))["v"]
            elif kind == "sum":
                summary.append(F.sum(v).alias(s))
                carried.append(F.sum(s).over(before).alias(c))
                inside.append(F.sum(v).over(upto).alias(x))
                combined[name] = F.coalesce(F.col(x) + F.col(c), F.col(x), F.col(c))
            elif kind == "max":
                summary.append(F.max(v).alias(s))
                carried.append(F.max(s).over(before).alias(c))
                inside.append(F.max(v).over(upto).alias(x))
                combined[name] = F.greatest(F.col(x), F.col(c))
            else:
                raise ValueError(f"unknown calculation {kind!r}")
        carry = self.rows.groupBy("__part").agg(*summary).select("__part", *carried)
        names = [c for c in self.rows.columns if c not in columns]
        self.rows = (
            self.rows.select("*", *inside)
            # one row per partition, so its size is bounded by the partition count
            .join(F.broadcast(carry), "__part", "left")
            .select(*[F.col(f"`{c}`") for c in names], *[e.alias(n) for n, e in combined.items()])
        )
        return self

    def lag(self, name: str, value: Column | str) -> GlobalOrder:
        return self.add({name: ("lag", value)})

    def running_sum(self, name: str, value: Column | str) -> GlobalOrder:
        return self.add({name: ("sum", value)})

    def running_max(self, name: str, value: Column | str) -> GlobalOrder:
        return self.add({name: ("max", value)})

    def row_number(self, name: str) -> GlobalOrder:
        return self.running_sum(name, F.lit(1))

    def _new_value(self, value: str) -> None:
        self.lag("__prev", F.struct(F.col(value)))
        self.rows = self.rows.withColumn(
            "__new", F.when(F.col("__prev").eqNullSafe(F.struct(F.col(value))), 0).otherwise(1)
        ).drop("__prev")

    def dense_rank(self, name: str, value: str) -> GlobalOrder:
        """Dense rank of the leading order column; ties may span partitions."""
        self._new_value(value)
        self.running_sum(name, "__new")
        self.rows = self.rows.drop("__new")
        return self

    def rank(self, name: str, value: str) -> GlobalOrder:
        """Rank with gaps of the leading order column."""
        self._new_value(value)
        self.row_number("__n")
        self.running_max(name, F.when(F.col("__new") == 1, F.col("__n")))
        self.rows = self.rows.drop("__new", "__n")
        return self

    def result(self) -> DataFrame:
        return self.rows.drop("__id", "__part")


@dataclass(frozen=True)
class Chunks:
    """How long series are cut: rows per chunk, and a coarse, monotone version of their order."""

    coarse: Column
    rows: int = 100_000


def numbered(
    df: DataFrame, entity: Sequence[str], order: Sequence[str], coarse: Column,
    name: str = "__pos",
) -> DataFrame:
    """Row numbers (from 0) per entity without sorting an entity in one task.

    ``coarse`` is a rough, monotone version of the order, such as the day of a timestamp.
    Rows are counted per slice of it, and numbered inside their slice only.
    """
    sliced = df.withColumn("__slice", coarse)
    keys = [*entity, "__slice"]
    counts = sliced.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    before = (Window.partitionBy(*entity).orderBy("__slice")
              .rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(*keys, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"))
    inside = Window.partitionBy(*keys).orderBy(*order)
    return (
        sliced.withColumn("__rn", F.row_number().over(inside) - 1)
        .join(offsets, keys)
        .withColumn(name, F.col("__off") + F.col("__rn"))
        .drop("__rn", "__off", "__slice")
    )


def chunked_windows(
    df: DataFrame,
    entity: Sequence[str],
    order: Sequence[str],
    coarse: Column,
    calculate: Callable[[DataFrame, WindowSpec], DataFrame],
    halo_rows: int,
    chunk_rows: int = 100_000,
) -> DataFrame:
    """Row-frame windows over chunks of each entity's series.

    Every chunk also gets copies of the ``halo_rows`` rows before it, so frames reaching
    at most that far back are exact; the copies are dropped after ``calculate``. Chained
    frames need the sum of their lengths.
    """
    if halo_rows > chunk_rows:
        raise ValueError("chunk_rows must not be below halo_rows")
    home = F.floor(F.col("__pos") / chunk_rows)
    near_end = F.col("__pos") % chunk_rows >= chunk_rows - halo_rows
    spread = numbered(df, entity, order, coarse).withColumn(
        "__chunk",
        F.explode(F.when(near_end, F.array(home, home + 1)).otherwise(F.array(home))),
    )
    window = Window.partitionBy(*entity, "__chunk").orderBy("__pos")
    out = calculate(spread, window)
    return out.filter(F.col("__chunk") == home).drop("__chunk", "__pos")


def chunked_ranges(
    df: DataFrame,
    entity: Sequence[str],
    position: Column,
    calculate: Callable[[DataFrame, WindowSpec], DataFrame],
    halo: int,
    chunk: int,
) -> DataFrame:
    """Range-frame windows over chunks of each entity's series, cut by an integer position.

    ``position`` (days, seconds) is also what the windows are ordered by, so frames of ``rangeBetween``
    count in its units. Every chunk gets copies of the rows of the ``halo`` units before it, and drops them
    after ``calculate``: frames reaching at most that far back are exact, and chained frames need the sum
    of their reaches. The position itself names the chunk, so nothing is numbered and the only shuffle
    is that of the windows. Rows without a position form a chunk of their own, as they are
    peers of each other alone.
    """
    if not 0 <= halo <= chunk:
        raise ValueError("halo must be between 0 and chunk")
    home = F.floor(F.col("__at") / chunk)
    near_end = F.pmod(F.col("__at"), F.lit(chunk)) >= chunk - halo
    spread = df.withColumn("__at", position.cast("long")).withColumn(
        "__chunk", F.explode(F.when(near_end, F.array(home, home + 1)).otherwise(F.array(home))))
    window = Window.partitionBy(*entity, "__chunk").orderBy("__at")
    out = calculate(spread, window)
    return out.filter(F.col("__chunk").eqNullSafe(home)).drop("__chunk", "__at")
