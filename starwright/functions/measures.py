"""Aggregate measures as Columns.

A measure is ``Measure(key, field, agg, …)`` over a column or SQL expression, or
``Measure(key, {"fn": …})`` computed from measures named before it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starwright.operators.ordered import GlobalOrder
from starwright.session import durable

AGGREGATES: dict[str, Callable[[Column], Column]] = {
    "sum": F.sum,
    "avg": F.avg,
    "min": F.min,
    "max": F.max,
    "count": F.count,
    "count_distinct": F.count_distinct,
    "approx_count_distinct": F.approx_count_distinct,
    "stddev": F.stddev_samp,
    "variance": F.var_samp,
}

ROW_ORDERED = ("delta", "pct_delta")


@dataclass(frozen=True)
class Measure:
    """One measure.

    ``field`` is a column name, SQL text, Column or ``{"fn": …}``. ``where`` keeps only
    some rows for this measure (SQL text or a list of them, all required).
    """

    key: str
    field: object = "*"
    agg: str | None = "sum"
    fmt: str | None = None
    label: str | None = None
    where: object = None

    @property
    def computed(self) -> bool:
        return isinstance(self.field, dict)

    @property
    def title(self) -> str:
        return self.label or self.key.replace("_", " ").title()


def measure(spec: object) -> Measure:
    """Measure from a Measure, a ``[key, field, agg, format, label]`` list or a dict."""
    if isinstance(spec, Measure):
        return spec
    if isinstance(spec, dict):
        return Measure(
            spec["key"], spec.get("field", "*"), spec.get("aggregation", spec.get("agg")),
            spec.get("format"), spec.get("label"), spec.get("where"),
        )
    key, field, agg, fmt, label = (list(spec) + [None] * 5)[:5]
    return Measure(key, field, agg, fmt, label)


def conditions(where: object) -> Column | None:
    """AND of SQL conditions or Columns; None when there are none."""
    parts = [] if where is None else where if isinstance(where, (list, tuple)) else [where]
    total = None
    for part in parts:
        cond = F.expr(part) if isinstance(part, str) else part
        total = cond if total is None else total & cond
    return total


def operand(m: Measure, resolve: Callable[[str], Column] = F.expr) -> Column:
    """What the measure aggregates, NULL on rows its ``where`` leaves out."""
    if m.field is None or isinstance(m.field, str) and m.field == "*":
        value = F.lit(1)
    else:
        value = resolve(m.field) if isinstance(m.field, str) else m.field
    cond = conditions(m.where)
    return value if cond is None else F.when(cond, value)


def aggregate_column(m: Measure, resolve: Callable[[str], Column] = F.expr) -> Column:
    """The aggregate of one base measure. Agg ``expression`` takes the SQL as it stands."""
    if m.agg == "expression":
        return F.expr(m.field).alias(m.key)
    name = (m.agg or "avg").lower()
    if name not in AGGREGATES:
        raise ValueError(f"unknown aggregate {m.agg!r}")
    return AGGREGATES[name](operand(m, resolve)).alias(m.key)


def computed_column(fn: dict, ref: Callable[[object], Column]) -> Column:
    """Arithmetic over earlier measures. ``ref`` gives the Column of a measure key."""
    name = fn["fn"]
    if name == "divide":
        a, b = ref(fn.get("a", fn.get("of"))), ref(fn.get("b", fn.get("by")))
        return F.try_divide(a.cast("double"), F.nullif(b, F.lit(0)))
    if name == "rate":
        return F.try_divide(
            ref(fn["events"]).cast("double"), F.nullif(ref(fn["exposed"]), F.lit(0))
        )
    if name == "subtract":
        return ref(fn["from"]) - ref(fn["subtract"])
    if name == "add":
        total = ref(fn["fields"][0])
        for key in fn["fields"][1:]:
            total = total + ref(key)
        return total
    if name == "multiply":
        return ref(fn.get("a", fn.get("of"))) * ref(fn["by"])
    raise ValueError(f"unknown computation {name!r}")


def as_operand(value: object) -> Column:
    """A measure key as its column, a number as a literal."""
    return F.col(f"`{value}`") if isinstance(value, str) else F.lit(value)


def with_computed(df: DataFrame, measures: Sequence[Measure]) -> DataFrame:
    """Add the computed measures, in order, over already aggregated columns."""
    for m in measures:
        if m.computed and m.field["fn"] not in (*ROW_ORDERED, "share"):
            df = df.withColumn(m.key, computed_column(m.field, as_operand))
    return df


def aggregate(
    df: DataFrame,
    by: Sequence[str | Column],
    measures: Sequence[object],
    resolve: Callable[[str], Column] = F.expr,
) -> DataFrame:
    """Group (or reduce to one row) and evaluate measures, computed ones included."""
    ms = [measure(m) for m in measures]
    base = [aggregate_column(m, resolve) for m in ms if not m.computed]
    out = df.groupBy(*by).agg(*base) if by else df.agg(*base)
    return with_computed(out, ms)


def sum_if(cond: str | Column, value: str | Column) -> Column:
    """Sum of ``value`` over the rows meeting ``cond``, 0 for the others."""
    test = F.expr(cond) if isinstance(cond, str) else cond
    x = F.expr(value) if isinstance(value, str) else value
    return F.sum(F.when(test, x).otherwise(F.lit(0.0)))


def rate_of(cond: str | Column, scale: float = 100.0) -> Column:
    """Share of rows meeting ``cond``, times ``scale``; NULL over no rows."""
    test = F.expr(cond) if isinstance(cond, str) else cond
    hits = F.sum(F.when(test, 1).otherwise(0)).cast("double")
    return F.try_divide(F.lit(scale) * hits, F.nullif(F.count(F.lit(1)), F.lit(0)))


def ratio_of(num: Column, den: Column) -> Column:
    """Ratio of two aggregates, NULL when the lower one is 0."""
    return F.try_divide(num.cast("double"), F.nullif(den, F.lit(0)))


def with_share(groups: DataFrame, value: str, name: str, scale: float = 1.0) -> DataFrame:
    """Share of each row in the sum of ``value``, for aggregated rows.

    The rows are kept first, so the facts behind them are not read a second time for the sum,
    and the sum is a scalar subquery, so the rows need not meet in one window.
    """
    kept = durable(groups)
    total = kept.select(F.sum(f"`{value}`").alias("t")).scalar()
    return kept.withColumn(name, F.try_divide(
        F.col(f"`{value}`").cast("double"), F.nullif(total, F.lit(0))) * scale)


def text_set(col: Column | str, separator: str = ", ") -> Column:
    """Sorted distinct values of a group as one text.

    The text is one value, so a group's distinct values must fit into a row; copies are dropped on the
    map side. For groups of any size use :func:`text_set_parts`.
    """
    return F.array_join(F.array_sort(F.collect_set(col)), separator)


def text_set_parts(
    df: DataFrame, keys: Sequence[str], col: str, name: str, separator: str = ", ", values: int = 10_000,
) -> DataFrame:
    """``(keys, part, name)``: sorted distinct non-null values per group, at most ``values`` in one text.

    Parts count from 0 and follow each other in the order of the values. Copies vanish before the
    distinct values are ranked along one global order, so a group with any number of them is spread
    over tasks.
    """
    value = F.col(f"`{col}`")
    distinct = df.filter(value.isNotNull()).select(
        F.struct(*[F.col(f"`{k}`") for k in keys]).alias("__k"), value.alias("__v")).distinct()
    placed = GlobalOrder(distinct, ["__k", "__v"]).rank("__first", "__k").row_number("__at").result()
    part = F.floor((F.col("__at") - F.col("__first")) / values).alias("part")
    listed = placed.groupBy("__k", part).agg(F.array_sort(F.collect_list("__v")).alias("__l"))
    return listed.select(*[F.col(f"__k.`{k}`").alias(k) for k in keys], "part",
                         F.array_join("__l", separator).alias(name))


def coefficient_of_variation(col: Column | str) -> Column:
    return ratio_of(F.stddev_samp(col), F.avg(col))
