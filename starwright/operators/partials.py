"""Partial aggregates: states of measures over fine groups that merge to coarser ones.

A sum, count, minimum or maximum is its own state; an average is a sum and a count; a
variance is (count, mean, sum of squared deviations); an approximate distinct count is a sketch. An exact
distinct count has no bounded state: its values become part of the group key, so that copies
vanish on the map side, and are counted once they are distinct.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starwright.functions import measures as M

ADDITIVE = ("sum", "count", "min", "max", "avg")
MOMENTS = ("stddev", "variance")
SKETCHED = "approx_count_distinct"
EXACT = "count_distinct"
SKETCH_BITS = 12  # 2 ** 12 registers


def kind_of(m: M.Measure) -> str:
    name = (m.agg or "avg").lower()
    if name not in (*ADDITIVE, *MOMENTS, SKETCHED, EXACT):
        raise ValueError(f"unknown aggregate {m.agg!r}")
    return name


@dataclass(frozen=True)
class Part:
    """One column of a state: its name, its aggregate over raw rows, and how it merges."""

    name: str
    raw: Column
    how: str


def parts(m: M.Measure) -> list[Part]:
    """The state of a measure; none for an exact distinct count."""
    kind, x, name = kind_of(m), M.operand(m), f"__{m.key}"
    if kind == "avg":
        return [Part(f"{name}_s", F.sum(x), "sum"), Part(f"{name}_n", F.count(x), "count")]
    if kind in MOMENTS:
        x = x.cast("double")
        return [Part(f"{name}_n", F.count(x), "n"), Part(f"{name}_m", F.avg(x), "mean"),
                Part(f"{name}_q", F.var_pop(x) * F.count(x), "m2")]
    if kind == SKETCHED:
        return [Part(name, F.hll_sketch_agg(x.cast("string"), F.lit(SKETCH_BITS)), "hll")]
    return [] if kind == EXACT else [Part(name, {
        "sum": F.sum, "count": F.count, "min": F.min, "max": F.max}[kind](x), kind)]


def value_name(m: M.Measure) -> str:
    return f"__{m.key}_v"


def grouped(df: DataFrame, keys: Sequence[str | Column], ms: Sequence[M.Measure]) -> DataFrame:
    """One pass over raw rows: states per keys, and per value of each exact distinct count."""
    values = [M.operand(m).alias(value_name(m)) for m in ms if kind_of(m) == EXACT]
    states = [p.raw.alias(p.name) for m in ms for p in parts(m)]
    return df.groupBy(*keys, *values).agg(*(states or [F.lit(1).alias("__present")]))


def centers(states: DataFrame, ms: Sequence[M.Measure]) -> dict[str, float]:
    """The overall mean of every measure with moments, by key: merging deviations from it is stable."""
    moments = [m for m in ms if kind_of(m) in MOMENTS]
    if not moments:
        return {}
    row = states.agg(*[F.try_divide(F.sum(F.col(f"`__{m.key}_m`") * F.col(f"`__{m.key}_n`")), F.sum(F.col(f"`__{m.key}_n`")))
                       .alias(m.key) for m in moments]).first()
    return {m.key: float(row[m.key] or 0.0) for m in moments}


def _moments(m: M.Measure, center: float, match: Column | None) -> tuple[Column, Column, Column]:
    n, mean, m2 = (F.col(f"`__{m.key}_{s}`") for s in "nmq")
    if match is not None:
        n, mean, m2 = F.when(match, n), F.when(match, mean), F.when(match, m2)
    off = mean - F.lit(center)
    count, moved = F.coalesce(F.sum(n), F.lit(0)), F.sum(n * off)
    around = F.sum(m2) + F.sum(n * off * off) - F.try_divide(moved * moved, F.nullif(count, F.lit(0)).cast("double"))
    return count, F.lit(center) + F.try_divide(moved, F.nullif(count, F.lit(0)).cast("double")), F.greatest(around, F.lit(0.0))


def merged_parts(m: M.Measure, center: Mapping[str, float]) -> list[Column]:
    """Aggregates over states that give the same state of a coarser group."""
    kind = kind_of(m)
    if kind in MOMENTS:
        return [c.alias(f"__{m.key}_{s}") for s, c in zip("nmq", _moments(m, center[m.key], None))]
    out = []
    for p in parts(m):
        x = F.col(f"`{p.name}`")
        merge = {"sum": F.sum, "count": F.sum, "min": F.min, "max": F.max, "hll": F.hll_union_agg}[p.how](x)
        out.append((F.coalesce(merge, F.lit(0)) if p.how == "count" else merge).alias(p.name))
    return out


def regrouped(states: DataFrame, keys: Sequence[str | Column], ms: Sequence[M.Measure],
              center: Mapping[str, float]) -> DataFrame:
    """States of coarser groups. Values of exact distinct counts are no longer part of the key."""
    aggs = [c for m in ms for c in merged_parts(m, center)]
    return states.groupBy(*keys).agg(*(aggs or [F.lit(1).alias("__present")]))


def finished(m: M.Measure, center: Mapping[str, float], match: Column | None = None) -> Column:
    """The measure as an aggregate over states, of those that ``match`` only."""
    kind = kind_of(m)
    if kind in MOMENTS:
        n, _, m2 = _moments(m, center[m.key], match)
        variance = F.when(n > 1, m2 / (n - 1))
        return F.sqrt(variance) if kind == "stddev" else variance
    merged = []
    for p in parts(m):
        x = F.col(f"`{p.name}`") if match is None else F.when(match, F.col(f"`{p.name}`"))
        if p.how == "count":
            merged.append(F.coalesce(F.sum(x), F.lit(0)))
        elif p.how == "hll":
            merged.append(F.coalesce(F.hll_sketch_estimate(F.hll_union_agg(x)), F.lit(0)))
        else:
            merged.append({"sum": F.sum, "min": F.min, "max": F.max}[p.how](x))
    return F.try_divide(merged[0], F.nullif(merged[1], F.lit(0))) if kind == "avg" else merged[0]


def distinct_values(states: DataFrame, keys: Sequence[str], m: M.Measure) -> DataFrame:
    """The distinct (keys, value) of an exact distinct count, without NULL values."""
    return states.select(*keys, value_name(m)).filter(F.col(f"`{value_name(m)}`").isNotNull()).distinct()
